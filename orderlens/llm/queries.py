"""Corpus queries over the given tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.llm import decontaminate, extraction, fingerprint, licenses, line_dedup, merkle, near_dedup, packing, pii, search, sharding, toxicity, wavelet
from orderlens.llm.common import pick, table, utf8_crc32
from orderlens.llm.license_rules import RULES


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op2_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    found = near_dedup.cluster(table(spark, sf_dir, "documents"), 4)
    return found.select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def op4_block_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extraction.extract(table(spark, sf_dir, "pages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that repeat an earlier one, nearly or fully."""
    return line_dedup.remove_lines(pick(table(spark, sf_dir, "documents"), "doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


def op6_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint.compare_with_next(table(spark, sf_dir, "documents"))


def op3_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as wavelet matrices and read back."""
    docs = wavelet.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return docs.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents, and the words that disclose it."""
    found = pii.find_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *(count(k) for k in ("email", "ip", "card", "phone")),
        F.sha2(pii.join_spans(F.col("base")), 256).alias("base_sha256"),
        pii.join_spans(pii.all_spans(F.col("base"), F.col("terms"))).alias("spans"),
    )


def op8_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    sharded = sharding.histogram_shards(table(spark, sf_dir, "documents"), 40)
    return sharded.select(
        "doc_id",
        sharding.row_size().alias("size"),
        utf8_crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_bounded_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of up to 4096 tokens."""
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in all documents."""
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.size("hit_words").cast("long")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        (F.size("item_ids") + F.col("nameless").cast("int")).cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated(F.col("n_words"), n_hit).alias("contaminated"),
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle tree of all documents by language, and what every proof says of a tampered row."""
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "source", "lang", "n_chars", "text")
    head, text = [F.col("doc_id"), F.col("source"), F.col("lang")], F.col("text")
    tampered = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(7)) == 0
    carry = {
        "doc_id": F.col("doc_id"),
        "tampered": F.when(tampered, merkle.leaf(*head, F.col("n_chars") + 1, text)),
    }
    found = merkle.manifest(docs, merkle.leaf(*head, F.col("n_chars"), text), "lang", "doc_id", carry)
    found = found.withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof")))
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        merkle.proof_digest(F.col("proof")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op12_pair_bound_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for every benchmark item."""
    index = search.build(table(spark, sf_dir, "documents"))
    return search.search(index, table(spark, sf_dir, "benchmark"), 50).drop("query")


def op13_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence signatures in all documents."""
    return licenses.summary(licenses.detect(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_odd_sketches": op2_odd_sketches,
    "op4_block_field": op4_block_field,
    "op5_line_dedup": op5_line_dedup,
    "op6_weighted_sampling": op6_weighted_sampling,
    "op3_wavelet_shards": op3_wavelet_shards,
    "op7_disclosure": op7_disclosure,
    "op8_histogram_shards": op8_histogram_shards,
    "op9_bounded_packing": op9_bounded_packing,
    "op10_decontaminate": op10_decontaminate,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_pair_bound_search": op12_pair_bound_search,
    "op13_license_rules": op13_license_rules,
}
#: Links over all pairs that share a shingle, and what is reachable by them.
_NEAR = r"""WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = d.doc_id LEFT JOIN sizes z ON z.doc_id = d.doc_id
"""

#: Trees level by level, then every leaf's way up, first in its language, then to the root.
_MERKLE = r"""WITH RECURSIVE fields AS (
  SELECT doc_id, lang,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS n,
    coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') AS n1,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    coalesce(xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
      lambda c: [ascii(c), 0, 0, 0, 0, 0, 0, 0]))),
      lambda a, e: xor(xor(a, e) >> 1, 3988292384 * (xor(a, e) & 1))), 4294967295) % 7 = 0, false) AS bad
  FROM documents
), hashed AS (
  SELECT doc_id, lang, sha256(head || n || tail) AS leaf, sha256(head || CASE WHEN bad THEN n1 ELSE n END || tail) AS shown
  FROM fields
), leaves AS (
  SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
    count(*) OVER (PARTITION BY lang) AS n
  FROM hashed
), tree(lang, level, place, h, n) AS (
  SELECT lang, 0, place, leaf, n FROM leaves
  UNION ALL
  SELECT lang, level + 1, place // 2, sha256(string_agg(h, '' ORDER BY place)), (n + 1) // 2
  FROM tree WHERE n > 1 GROUP BY lang, level, place // 2, n
), tops AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM tree WHERE n = 1
), crown(level, place, h, n) AS (
  SELECT 0, place, h, n FROM tops
  UNION ALL
  SELECT level + 1, place // 2, sha256(string_agg(h, '' ORDER BY place)), (n + 1) // 2
  FROM crown WHERE n > 1 GROUP BY level, place // 2, n
), way(id, lang, level, place, n, h, proof) AS (
  SELECT id, lang, 0, place, n, shown, '' FROM leaves
  UNION ALL
  SELECT w.id, w.lang, w.level + 1, w.place // 2, (w.n + 1) // 2,
    sha256(CASE WHEN w.place % 2 = 0 THEN w.h || coalesce(s.h, '') ELSE coalesce(s.h, '') || w.h END),
    w.proof || coalesce(s.h, '')
  FROM way w LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM w.lang AND s.level = w.level AND s.place = xor(w.place, 1)
  WHERE w.n > 1
), up(id, level, place, n, h, proof) AS (
  SELECT w.id, 0, t.place, t.n, w.h, w.proof FROM way w JOIN tops t ON t.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
  UNION ALL
  SELECT u.id, u.level + 1, u.place // 2, (u.n + 1) // 2,
    sha256(CASE WHEN u.place % 2 = 0 THEN u.h || coalesce(s.h, '') ELSE coalesce(s.h, '') || u.h END),
    u.proof || coalesce(s.h, '')
  FROM up u LEFT JOIN crown s ON s.level = u.level AND s.place = xor(u.place, 1)
  WHERE u.n > 1
)
SELECT l.doc_id, l.leaf, t.h AS subroot, r.h AS root, sha256(u.proof) AS proof_sha256, u.h AS folded_root, u.h = r.h AS verified
FROM leaves l JOIN tops t ON t.lang IS NOT DISTINCT FROM l.lang JOIN up u ON u.id = l.id AND u.n = 1
JOIN crown r ON r.n = 1
"""


#: Every document scored for every item.
_SEARCH = r"""WITH texts AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), held AS (
  SELECT d, doc_id, len(w) AS n, w FROM texts WHERE len(w) > 0
), counts AS (
  SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM held
), postings AS (
  SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(w) AS term FROM held) GROUP BY ALL
), asked AS (
  SELECT DISTINCT q, item_id, term FROM (SELECT row_number() OVER () AS q, item_id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * nn + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), counts
), scored AS (
  SELECT q, item_id, p.d, any_value(doc_id) AS doc_id,
    CAST(sum(x.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // l)))) AS BIGINT) AS score
  FROM asked a JOIN postings p ON p.term = a.term JOIN weights x ON x.term = a.term JOIN held h ON h.d = p.d, counts
  GROUP BY q, item_id, p.d
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
"""


def _license_sql() -> str:
    """All rules at all places, and containment of every two detections of a text."""
    rules = ", ".join(
        f"('{start}', {n}, '{r.label}', {r.priority}, {r.weight}, {str(r.base).lower()}, '^{r.pattern} ')"
        for n, r in enumerate(RULES)
        for start in r.starts
    )
    return rf"""WITH rules(start, rule, label, priority, weight, base, pattern) AS (VALUES {rules}),
texts AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), each_word AS (
  SELECT id, unnest(generate_series(1, len(w))) AS i, unnest(w) AS word FROM texts
), places AS (
  SELECT id, i, word AS start FROM each_word WHERE word IN (SELECT start FROM rules)
  UNION ALL
  SELECT a.id, a.i, a.word || ' ' || b.word FROM each_word a JOIN each_word b ON b.id = a.id AND b.i = a.i + 1
  WHERE a.word || ' ' || b.word IN (SELECT start FROM rules)
), tried AS (
  SELECT p.id, p.i - 1 AS a, rule, label, priority, weight, base,
    regexp_extract(array_to_string(w[p.i:p.i + 39], ' ') || ' ', pattern) AS match
  FROM places p JOIN rules r ON r.start = p.start JOIN texts t ON t.id = p.id
), found AS (
  SELECT *, a + length(match) - length(replace(match, ' ', '')) AS z FROM tried WHERE match <> ''
), told AS (
  SELECT * FROM found f WHERE base OR NOT EXISTS (
    SELECT 1 FROM found g WHERE g.id = f.id AND g.a <= f.a AND g.z >= f.z AND g.priority <= f.priority
      AND (g.a < f.a OR g.z > f.z OR g.priority < f.priority OR g.rule < f.rule))
)
SELECT t.doc_id, CAST(len(any_value(w)) AS BIGINT) AS n_words, count(*) FILTER (base) AS n_base,
  min(a) FILTER (base) AS first_word, max(a) FILTER (base) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, CAST(coalesce(max(weight), 0) AS DOUBLE) AS score
FROM texts t LEFT JOIN told d ON d.id = t.id GROUP BY t.id, t.doc_id
"""


ORACLES = {
    "op2_odd_sketches": _NEAR,
    "op11_merkle_manifest": _MERKLE,
    "op12_pair_bound_search": _SEARCH,
    "op13_license_rules": _license_sql(),
}
