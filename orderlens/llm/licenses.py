"""Licence scan: ordered signature rules over the words of a text.

The text is taken as its words in lower case (A-Z only), so rules see one space between
words whatever the layout, comment signs or punctuation.  Rules are regular expressions
(``license_rules``), gated twice: a text is looked at only if it holds a keyword of a
rule, and a rule is tried only in texts that hold its own keyword, at places where its
first words stand.  The cost of a place is bounded by the longest rule, so long texts
cost what they hold.

Detections that overlap are settled by containment: one that lies inside another of a
better priority, or of the same priority and longer, says nothing of its own and is
``covered``.  Rules of the base are reported in any case.

Everything is built of DataFrame functions.  Detections go by row to one task each, and a
row's own line goes with them, so rows without any stay; rows are told apart by a number of
their own, whatever their ids.  A null text has no words; empty tables give none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderlens.llm.common import pick, text_or_empty
from orderlens.llm.license_rules import MENTION, RULES, TEXT

#: A word, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words that a rule may look at, from its first one on; no rule is longer.
REACH = 40


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def _rule_rows(spark: SparkSession) -> DataFrame:
    """The fixed rules by how they start; ``nth`` counts the rules of one start."""
    rows, seen = [], {}
    for number, r in enumerate(RULES):
        for start in r.starts:
            seen[start] = nth = seen.get(start, -1) + 1
            rows.append((start, nth, number, r.keywords, f"^{r.pattern} ", r.label, r.priority, r.weight, r.base))
    schema = "start string, nth int, rule int, keywords array<string>, pattern string, label string, priority int, weight double, base boolean"
    return spark.createDataFrame(rows, schema)


def _keywords() -> list[str]:
    return sorted({k for r in RULES for k in r.keywords})


def _places(words: Column, present: Column) -> Column:
    """Where rules may start: (at, start, ahead), with the words that follow."""
    one = sorted({s for r in RULES for s in r.starts if " " not in s})
    two = sorted({s for r in RULES for s in r.starts if " " in s})
    firsts = sorted({s.split(" ")[0] for s in two})

    def start_at(word: Column, at: Column) -> Column:
        pair = F.concat(word, F.lit(" "), F.get(words, at + 1))
        alone = F.when(word.isin(one), word)
        both = F.when(word.isin(firsts), F.when(pair.isin(two), pair))
        return F.struct(at.alias("at"), F.filter(F.array(alone, both), lambda s: s.isNotNull()).alias("starts"))

    marked = F.filter(F.transform(words, start_at), lambda p: F.size(p["starts"]) > 0)
    ahead = lambda p: F.concat(F.array_join(F.slice(words, p["at"] + 1, REACH), " "), F.lit(" "))
    full = F.flatten(
        F.transform(marked, lambda p: F.transform(p["starts"], lambda s: F.struct(p["at"], s.alias("start"), ahead(p).alias("ahead"))))
    )
    return F.when(F.size(present) > 0, full)


def detect(docs: DataFrame) -> DataFrame:
    """One row per detection of every row of ``docs`` (doc_id, text; other columns are ignored).

    Columns: row (a number), doc_id, n_words, start and end (words from 0, end exclusive),
    rule, label, priority, weight, base, covered.  A row of ``docs`` may come once more with
    nulls from ``start`` on, and does so if it has no detection.
    """
    texts = pick(docs, "doc_id", "text").select(
        F.monotonically_increasing_id().alias("row"), "doc_id", words_of(text_or_empty()).alias("words")
    )
    keywords = F.array(*(F.lit(k) for k in _keywords()))
    found = texts.withColumn("present", F.array_intersect("words", keywords))
    found = found.select(
        "row", "doc_id", F.size("words").cast("long").alias("n_words"), "present", _places(F.col("words"), F.col("present")).alias("places")
    )
    each = found.select("row", "doc_id", "n_words", "present", F.posexplode_outer("places").alias("pos", "place"))
    each = each.select("row", "doc_id", "n_words", "present", "pos", F.col("place.at").alias("at"), "place.start", "place.ahead")
    rules = F.broadcast(_rule_rows(docs.sparkSession))
    tried = each.join(rules, "start", "left")
    match = F.when(F.arrays_overlap("present", "keywords"), F.call_function("regexp_extract", "ahead", "pattern", F.lit(0)))
    tried = tried.withColumn("match", F.nullif(match, F.lit("")))
    hit = F.col("match").isNotNull()
    own_line = (F.coalesce("pos", F.lit(0)) == 0) & (F.coalesce("nth", F.lit(0)) == 0)
    length = F.length("match") - F.length(F.replace("match", F.lit(" "), F.lit("")))
    keep = ["rule", "label", "priority", "weight", "base"]
    kept = tried.where(hit | own_line).select(
        "row",
        "doc_id",
        "n_words",
        F.when(hit, F.col("at").cast("long")).alias("start"),
        F.when(hit, (F.col("at") + length).cast("long")).alias("end"),
        *(F.when(hit, F.col(c)).alias(c) for c in keep),
    )
    return kept.withColumn("covered", _covered())


def _covered() -> Column:
    """Whether one of the detections that start no later reaches as far and is stronger."""
    order = Window.partitionBy("row").orderBy(F.col("start").asc_nulls_first(), F.col("end").desc(), "priority", "rule")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    tests = []
    for p in range(TEXT, MENTION + 1):
        reach = F.max(F.when(F.col("priority") <= p, F.col("end"))).over(before)
        tests.append((F.col("priority") == p) & F.coalesce(reach >= F.col("end"), F.lit(False)))
    return reduce(lambda a, b: a | b, tests)


def summary(detections: DataFrame) -> DataFrame:
    """One row per text: places and labels of the base, all labels, and the strongest weight (0 to 1)."""
    base = F.coalesce("base", F.lit(False))
    told = base | (~F.coalesce("covered", F.lit(True)))

    def labels(when: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")

    return (
        detections.groupBy("row", "doc_id", "n_words")
        .agg(
            F.count_if(base).alias("n_base"),
            F.min(F.when(base, F.col("start"))).alias("first_word"),
            F.max(F.when(base, F.col("start"))).alias("last_word"),
            labels(base).alias("base_labels"),
            labels(told).alias("labels"),
            F.coalesce(F.max(F.when(told, F.col("weight"))), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )
