"""The whole run: load, clean, enrich, report and export."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.operators import clean
from orderlens.operators.features import clean_layout, engineer_features
from orderlens.plans.report import run_eda
from orderlens.schema import CLEAN_COLUMNS, SOURCE
from orderlens.sources.csvfiles import load_data, resolve_source
from orderlens.sources.rejects import load_with_rejects
from orderlens.sources.tables import write_csv, write_table


@dataclass(frozen=True)
class Run:
    raw: DataFrame
    lines: DataFrame
    quality: DataFrame
    report: DataFrame
    rejected: DataFrame | None = None


def prepare(raw: DataFrame) -> DataFrame:
    """Raw file to clean, enriched lines; ``row_id`` lives on as ``line_seq``."""
    named = clean.clean_column_names(raw)
    cleaned = clean.clean_data(named)
    if "row_id" in cleaned.columns:
        cleaned = cleaned.withColumn("line_seq", F.col("row_id").cast("long"))
    return engineer_features(clean.drop_columns(cleaned))


def run(
    spark: SparkSession,
    real: str,
    sample: str,
    table_path: str,
    csv_path: str | None = None,
    reject_path: str | None = None,
) -> Run:
    """Run all stages; the clean lines are stored once and read from there.

    The table is partitioned by year; ``csv_path`` adds a CSV copy in the
    27-column layout.  With ``reject_path`` lines that do not fit are kept there with their
    reason and the others go on; without it the first such line stops the run.
    """
    rejected = None
    if reject_path:
        load = load_with_rejects(spark, resolve_source(spark, real, sample).path, SOURCE, reject_path)
        raw, rejected = load.accepted, load.rejected
    else:
        raw = load_data(spark, real, sample).drop("source_kind")
    lines = prepare(raw)
    extra = tuple(c for c in lines.columns if c not in CLEAN_COLUMNS)
    stored = write_table(clean_layout(lines, extra), table_path, ("year",))
    if csv_path:
        write_csv(clean_layout(stored), csv_path)
    quality = clean.quality_report(clean.clean_column_names(raw))
    return Run(raw, stored, quality, run_eda(stored), rejected)
