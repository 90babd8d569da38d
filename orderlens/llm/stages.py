"""Stages of the corpus pipeline: documents in, documents out, and packed sequences at the end.

Each takes (spark, docs, sf_dir); ``docs`` has doc_id, text and any other columns, which
are handed on.  Rows with nulls anywhere, empty texts and repeated rows are treated as
the operators say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.llm import decontaminate, line_dedup, near_dedup, packing
from orderlens.llm import toxicity as toxic
from orderlens.llm.common import scratch, stage, table, with_rest, without_rest

#: Words of a shingle in the near-duplicate stage.
SHINGLE = 5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5; a document without text is clean."""
    model = toxic.train(docs, table(spark, sf_dir, "labels"))
    scored = with_rest(docs).withColumn("score", toxic.scorer(spark, model)("text"))
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    return without_rest(scored.where(blank | (F.col("score") < 0.5)), docs.columns)


def line_dedup_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; one that has lost all it said is gone."""
    found = line_dedup.remove_lines(docs)
    empty = F.length(F.trim(F.regexp_replace("text", r"\s+", " "))) == 0
    return without_rest(found.where(~((F.col("n_removed") > 0) & empty)), docs.columns, new_text=True)


def near_dedup_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of the least id of each group (a null id comes last), and rows of no group.

    Rows have numbers of their own, written once, so rows that share an id, or have
    none, are judged each by its text; of equal rows one stays.
    """
    numbered = docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).withColumn("row", F.monotonically_increasing_id())
    numbered = stage(numbered, "rows")
    own = {n: F.col(f"c{docs.columns.index(n)}") for n in ("doc_id", "text")}
    with scratch(spark):
        repeated = stage(_repeated(numbered, own), "repeated", result=True)  # of known size when texts are joined
    return numbered.join(repeated, "row", "left_anti").drop("row").toDF(*docs.columns)


def _repeated(numbered: DataFrame, own: dict[str, Column]) -> DataFrame:
    """Rows of near-duplicate groups that come after the first of their group."""
    found = near_dedup.cluster(numbered.select(F.col("row").alias("doc_id"), own["text"].alias("text")), SHINGLE)
    found = found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    place = F.struct(own["doc_id"].isNull().alias("no_id"), own["doc_id"].alias("doc_id"), "row")
    grouped = stage(numbered.select("row", place.alias("place")).join(found, "row"), "groups")
    several = grouped.groupBy("group").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    return grouped.join(several, "group").where(F.col("row") != F.col("first.row")).select("row")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less than a twentieth of whose words lie in benchmark windows."""
    numbered = stage(with_rest(docs).withColumn("row", F.monotonically_increasing_id()), "rows")
    found = decontaminate.search(numbered.select("row", F.lit(None).cast("long").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    bad = found.where(decontaminate.is_contaminated(F.col("n_words"), F.size("hit_words"))).select("row")
    bad = stage(bad, "contaminated")  # few rows, of known size when texts are joined
    return without_rest(numbered.join(bad, "row", "left_anti"), docs.columns)


def packing_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of up to 4096 tokens, with their ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2)
