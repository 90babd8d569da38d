"""Corpus cleaning, stage by stage, each over all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orderlens.llm import stages
from orderlens.llm.common import fresh_path, table

STAGES = [
    ("toxicity", stages.toxicity),
    ("line_dedup", stages.line_dedup_),
    ("near_dedup", stages.near_dedup_),
    ("decontamination", stages.decontamination),
    ("packing", stages.packing_),
]

#: Training a model and tokenising have no SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
