"""Personal data: patterns, and terms that give protected entities away.

Mail and network addresses, payment cards and telephone numbers are found by pattern.
Each distinct value found is a protected entity, and so are each kind and, for mail,
each name before the sign, whatever their values.  Words can give an entity away even
where it is blotted out: those that in the whole corpus stand beside it and hardly
anywhere else.  That is asked of lines and of whole texts.  With counts over all lines
(texts), the information that a word t holds of an entity e is log(n(e,t) N / (n(e) n(t))),
and e's own information is log(N / n(e)); their ratio, 1 at most, is the share of e that
t discloses.  In lines (texts) that hold e, words disclosing it beyond one threshold are
generalised to a placeholder, beyond a higher one removed.  Counts of less than a few
different lines prove nothing and are left; equal lines of a text count once; an entity
in half of all lines has less than a bit to disclose and is left as well.

Bad input: a null text has no spans; a null id stays null; repeated rows are judged
each and count each; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import pick, ship, stage
from orderlens.llm.tokens import text_slices

#: Kinds in the order in which spans that start together stand.
KINDS = ("email", "ip", "card", "phone", "term")
#: Shares of an entity's information from which a word is generalised, and removed.
GENERALISE, REMOVE = 0.9, 0.98
#: Different lines that must hold an entity and a word together.
SUPPORT = 3
#: Words that a task holds before it sends their counts.
HELD_WORDS = 500_000
#: Bits of the table that keeps words beside no entity out of the counts; more words fill it, and cost, never lose, counts.
FILTER_BITS = 1 << 25

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: The same from the beginning of a run of letters that can stand before the sign; later beginnings can do no better.
_EMAIL_RUN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]{3,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[re.Match]:
    """All matches from the left, in time that grows with the text only."""
    at = 0
    while m := _EMAIL.match(text, at) or _EMAIL_RUN.search(text, at):  # a match can end within a run
        yield m
        at = m.end()


def find_base(text: str | None) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) by pattern, in order."""
    out: list[tuple[int, int, str]] = []
    if not text:
        return out
    if "@" in text:
        out += [(*m.span(), "email") for m in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append((*m.span(), "ip"))
        for m in _CARD.finditer(text):
            digits = "".join(_DIGIT.findall(m[0]))
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                    out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def entity(kind: str, value: str) -> str:
    """One name for the spellings of a value."""
    return f"{kind}:{value.lower() if kind == 'email' else ''.join(c for c in value if c.isdigit() or c == '.' and kind == 'ip')}"


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode()) - (1 << 63)


_SPAN = "struct<begin:long,stop:long,kind:string>"
_FOUND = f"doc_id long, spans array<{_SPAN}>, words array<struct<word:long,line:long,beside:boolean,begin:int,stop:int>>, held array<struct<entity:long,line:long,whole:boolean>>"


def names(kind: str, value: str) -> list[str]:
    """What a value is protected as: itself, its kind, and the name in a mail address."""
    out = [entity(kind, value), f"kind:{kind}"]
    return [*out, f"name:{value.lower().rpartition('@')[0]}"] if kind == "email" else out


def _entity_hash(name: str, whole: bool) -> int:
    return _hash(f"{'text' if whole else 'line'} {name}")


def _words(text: str) -> list[tuple[int, int, str]]:
    """Places of the words of a text, and their names."""
    return [(*m.span(), m[0].lower()) for m in _WORD.finditer(text)]


def _beside(text: str, spans: list[tuple[int, int, str]]) -> tuple[list[dict], list[dict]]:
    """Words of a text outside its spans (and whether their line has one), and the entities of its lines and of the whole."""
    held, words, begin = {}, [], 0
    whole, at = _hash(text), 0
    for line in text.split("\n"):
        name, stop = _hash(line), begin + len(line)
        first = at
        while at < len(spans) and spans[at][0] <= stop:  # a span belongs to the line where it begins
            a, b, kind = spans[at]
            at += 1
            for n in names(kind, text[a:b]):
                held[_entity_hash(n, False), name, False] = held[_entity_hash(n, True), whole, True] = None
        covered, k = _merged(spans[first:at]), 0
        for a, b, word in _words(line):
            a, b = begin + a, begin + b
            while k < len(covered) and covered[k][1] <= a:
                k += 1
            if k == len(covered) or covered[k][0] >= b:
                words.append({"word": _hash(word), "line": name, "beside": at > first, "begin": a, "stop": b})
        begin = stop + 1
    return words, [dict(zip(("entity", "line", "whole"), h, strict=True)) for h in held]


def _merged(spans: list[tuple[int, int, str]]) -> list[list[int]]:
    """What spans cover, as stretches that don't meet."""
    out: list[list[int]] = []
    for a, b, _ in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("begin", pa.int64()), ("stop", pa.int64()), ("kind", pa.string())])
    word = pa.struct([("word", pa.int64()), ("line", pa.int64()), ("beside", pa.bool_()), ("begin", pa.int32()), ("stop", pa.int32())])
    held = pa.struct([("entity", pa.int64()), ("line", pa.int64()), ("whole", pa.bool_())])
    for batch in (part for whole in batches for part in text_slices(whole)):
        texts = batch.column("text").to_pylist()
        spans = [find_base(t) for t in texts]
        beside = [_beside(t, s) if s else ([], []) for t, s in zip(texts, spans, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([[{"begin": a, "stop": b, "kind": k} for a, b, k in s] for s in spans], pa.list_(span)),
                pa.array([w for w, _ in beside], pa.list_(word)),
                pa.array([h for _, h in beside], pa.list_(held)),
            ],
            ["doc_id", "spans", "words", "held"],
        )


class _Lower(dict):
    """Words in lower case, each made once."""

    def __missing__(self, word: str) -> str:
        self[word] = low = word.lower()
        return low


def _count(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Lines and texts that hold each word whose hash is among ``bits``, and their numbers under a null.

    Words are added up over the whole task and sent when there are many.
    """
    lines, texts, n_lines, n_texts = Counter(), Counter(), 0, 0
    lower = _Lower()

    def sent() -> pa.RecordBatch:
        hashes = np.array([_hash(w) for w in lines], np.int64)
        keep = bits[hashes & (len(bits) - 1)] if len(hashes) else np.zeros(0, bool)
        full = np.array([(n, texts[w]) for w, n in lines.items()], np.int64).reshape(-1, 2)[keep]
        columns = [[*hashes[keep].tolist(), None], [*full[:, 0].tolist(), n_lines], [*full[:, 1].tolist(), n_texts]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["word", "lines", "texts"])

    for batch in (part for whole in batches for part in text_slices(whole)):
        for text in batch.column("text").to_pylist():
            own: set[str] = set()
            for line in dict.fromkeys((text or "").split("\n")):
                n_lines += 1
                words = set(map(lower.__getitem__, _WORD.findall(line)))
                lines.update(words)
                own |= words
            texts.update(own)
            n_texts += 1
        if len(lines) > HELD_WORDS or len(lower) > HELD_WORDS:
            yield sent()
            lines, texts, n_lines, n_texts = Counter(), Counter(), 0, 0
            lower.clear()
    yield sent()


def _bits(words: DataFrame) -> np.ndarray:
    """A bit for the hash of each word: a table of fixed size, built in the tasks."""
    at = F.col("word").bitwiseAND(FILTER_BITS - 1)
    parts = words.groupBy(F.shiftright(at, 15).alias("part")).agg(F.bitmap_construct_agg(at.bitwiseAND(32767)).alias("bits"))
    out = np.zeros((FILTER_BITS >> 15, 4096), np.uint8)
    for r in parts.collect():  # at most FILTER_BITS / 8 bytes
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return np.unpackbits(out.reshape(-1), bitorder="little").astype(bool)


def disclosure(together: Column, lines: Column, entity_lines: Column, word_lines: Column) -> Column:
    """Share of an entity's information that a word holds."""
    own = F.log(lines / entity_lines)
    return F.when(own >= np.log(2), F.log(together * lines / (entity_lines * word_lines)) / own).otherwise(F.lit(0.0))


def find_spans(docs: DataFrame, generalise: float = GENERALISE, support: int = SUPPORT) -> DataFrame:
    """Per row: doc_id, base (spans by pattern) and terms (begin, stop, share of what they disclose).

    Words meet entities only where they can disclose one.  A word that stands in h lines
    with any entity and in n lines at all discloses e only if min(h, n(e)) / n reaches
    (n(e) / N) ** (1 - generalise), and no entity of fewer than ``support`` lines counts;
    both bounds are exact, and leave few words and entities to be paired.
    """
    ship(docs.sparkSession)
    docs = pick(docs, "doc_id", "text")
    found = stage(docs.mapInArrow(_scan, _FOUND).withColumn("id", F.monotonically_increasing_id()), "spans")
    holding = found.where("size(held) > 0")
    words, numbers = _candidates(docs, holding, support)
    n = F.when(F.col("whole"), F.lit(numbers[True])).otherwise(F.lit(numbers[False]))
    reach = lambda together, entity: together / F.col("n") >= F.pow(F.try_divide(entity, n), 1 - generalise) * (1 - 1e-9)
    words = stage(words.where((F.col("h") >= support) & reach(F.col("h"), F.lit(float(support)))), "words")

    # lines (texts) of every row with the words that may tell, and with the entities that may be told
    spots = holding.select("id", F.explode("words").alias("w")).select("id", "w.*")
    spots = stage(spots.join(words.select("word").distinct(), "word"), "spots")
    unit = F.when(F.col("whole"), F.lit(0)).otherwise(F.col("line")).alias("unit")
    units = spots.join(words, "word").where("whole or beside").select("id", "whole", unit, "word", "h", "n").distinct()
    held = holding.select("id", F.explode("held").alias("e")).select("id", "e.*")
    entities = held.groupBy("entity", "whole").agg(F.count("*").alias("size")).where(F.col("size") >= support)
    entities = stage(entities, "entities")
    # entities of kinds are in many rows: their few sizes go to all tasks, the others are joined
    wide = F.col("entity").isin([_entity_hash(f"kind:{k}", whole) for k in KINDS for whole in (False, True)])
    few = F.broadcast(entities.where(wide))
    told = held.where(wide).join(few, ["entity", "whole"]).unionByName(held.where(~wide).join(entities, ["entity", "whole"]))
    told = told.select("id", "whole", unit, "entity", "line", "size")
    pairs = units.join(told, ["id", "whole", "unit"]).where(reach(F.least("h", "size"), F.col("size")))
    pairs = stage(pairs, "pairs")

    key = ["entity", "whole", "word", "size", "n"]
    counted = pairs.groupBy(*key, "line").agg(F.count("*").alias("c"))  # equal lines prove one thing
    counted = counted.groupBy(*key).agg(F.sum("c").alias("together"), F.count("*").alias("kinds")).where(F.col("kinds") >= support)
    share = F.least(disclosure(F.col("together"), n, F.col("size"), F.col("n")), F.lit(1.0)).alias("share")
    telling = counted.select("entity", "whole", "word", share).where(F.col("share") >= generalise)
    marked = pairs.join(telling, ["entity", "whole", "word"]).groupBy("id", "whole", "unit", "word").agg(F.max("share").alias("share"))
    marked = marked.withColumnsRenamed({"id": "_id", "word": "_word"})
    same = (F.col("id") == F.col("_id")) & (F.col("word") == F.col("_word")) & (F.col("whole") | (F.col("line") == F.col("unit")))
    terms = spots.join(marked, same).groupBy("id", "begin", "stop").agg(F.max("share").alias("share"))
    term = F.struct(F.col("begin").cast("long").alias("begin"), F.col("stop").cast("long").alias("stop"), "share")
    terms = terms.groupBy("id").agg(F.sort_array(F.collect_list(term)).alias("terms"))
    none = F.array().cast("array<struct<begin:long,stop:long,share:double>>")
    rows = found.select("id", "doc_id", F.col("spans").alias("base")).join(terms, "id", "left")
    return rows.select("doc_id", "base", F.coalesce("terms", none).alias("terms"))


def _candidates(docs: DataFrame, holding: DataFrame, support: int) -> tuple[DataFrame, dict[bool, float]]:
    """(word, whole, h, n) of words beside entities in ``support`` lines (texts) at least, and the numbers of lines and texts.

    ``h`` counts places in lines with an entity (rows with one), n lines (rows) at all.
    """
    one = F.lit(1).cast("long")
    in_lines = holding.select(F.explode(F.expr("filter(words, w -> w.beside).word")).alias("word"), one.alias("a"), (one * 0).alias("b"))
    in_texts = holding.select(F.explode(F.array_distinct("words.word")).alias("word"), (one * 0).alias("a"), one.alias("b"))
    beside = in_lines.unionAll(in_texts).groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    beside = stage(beside.where(F.greatest("a", "b") >= support), "beside")
    bits = docs.sparkSession.sparkContext.broadcast(_bits(beside))
    counts = docs.mapInArrow(lambda batches: _count(batches, bits.value), "word long, lines long, texts long")
    counts = stage(counts.groupBy("word").agg(F.sum("lines").alias("lines"), F.sum("texts").alias("texts")), "counts")
    totals = counts.where("word is null").agg(F.sum("lines"), F.sum("texts")).first()
    both = beside.join(counts.where("word is not null"), "word")
    scopes = F.array(
        F.struct(F.lit(False).alias("whole"), F.col("a").alias("h"), F.col("lines").alias("n")),
        F.struct(F.lit(True).alias("whole"), F.col("b").alias("h"), F.col("texts").alias("n")),
    )
    words = both.select("word", F.explode(scopes).alias("s")).select("word", "s.*")
    return words, {False: float(totals[0] or 0), True: float(totals[1] or 0)}


def sanitise(text: str | None, base: list, terms: list, remove: float = REMOVE) -> str | None:
    """The text with entities and telling words replaced or taken out."""
    if text is None:
        return None
    marks = [(b["begin"], b["stop"], f"[{b['kind'].upper()}]") for b in base]
    marks += [(t["begin"], t["stop"], "" if t["share"] >= remove else "[TERM]") for t in terms]
    out, at = [], 0
    for begin, stop, instead in sorted(marks, key=lambda m: (m[0], -m[1])):
        if begin >= at:
            out += [text[at:begin], instead]
        at = max(at, stop)
    return "".join(out) + text[at:]


def join_spans(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    one = lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["stop"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def all_spans(base: Column, terms: Column) -> Column:
    """Base spans and terms by start, then by kind as listed."""
    order = F.array(*(F.lit(k) for k in KINDS))
    rank = lambda s: F.struct(s["begin"], F.array_position(order, s["kind"]).alias("rank"), s["stop"], s["kind"])
    named = F.transform(terms, lambda t: F.struct(t["begin"], t["stop"], F.lit("term").alias("kind")))
    return F.array_sort(F.transform(F.concat(base, named), rank))


def sanitised(docs: DataFrame) -> DataFrame:
    """All rows with their texts sanitised: doc_id, text."""
    ship(docs.sparkSession)
    rows = stage(pick(docs, "doc_id", "text").withColumn("id", F.monotonically_increasing_id()), "rows")
    marks = find_spans(rows.select(F.col("id").alias("doc_id"), "text")).withColumnRenamed("doc_id", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = zip(*(batch.column(c).to_pylist() for c in ("text", "base", "terms")), strict=True)
            clean = [sanitise(t, b, w) for t, b, w in given]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(clean, pa.string())], ["doc_id", "text"])

    return rows.join(marks, "id").select("doc_id", "text", "base", "terms").mapInArrow(run, "doc_id long, text string")
