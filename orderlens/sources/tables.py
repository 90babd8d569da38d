"""Sinks: CSV export, Parquet tables, and a refreshable pre-aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Upper bound of rows per file, so that a hot year is spread over many files.
MAX_ROWS_PER_FILE = 5_000_000
# ... and per packed CSV file, which is read by one task.
MAX_ROWS_PER_PACKED = 500_000


def write_csv(df: DataFrame, path: str, packed: bool = False, append: bool = False) -> None:
    """Header CSV, parents created, earlier content replaced or added to; ``packed`` by gzip, which readers undo."""
    writer = df.write.mode("append" if append else "overwrite").option("header", True).option("quote", '"').option("escape", '"')
    if packed:
        writer = writer.option("compression", "gzip").option("maxRecordsPerFile", MAX_ROWS_PER_PACKED)
    writer.csv(path)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), append: bool = False) -> DataFrame:
    """Replace the Parquet table at ``path``, or add to it, and return a reader of it.

    Each task writes its own rows, so no shuffle precedes the write.
    """
    writer = df.write.mode("append" if append else "overwrite").option("maxRecordsPerFile", MAX_ROWS_PER_FILE)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def write_observed(
    df: DataFrame, path: str, measures: dict[str, Column], partition_by: tuple[str, ...] = ()
) -> tuple[DataFrame, dict[str, int]]:
    """:func:`write_table`, and aggregates of the very rows written, from the same pass.

    The aggregates are taken in the tasks that write, above the last shuffle, so a task that
    is run again counts once.  Over no rows a count is 0 and other aggregates are null.
    """
    seen = Observation()
    watched = df.observe(seen, *[m.alias(name) for name, m in measures.items()])
    return write_table(watched, path, partition_by), seen.get


def write_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int) -> DataFrame:
    """Bucketed and sorted table: later joins and groupings on ``key`` do not shuffle it.

    Rows of one key share a bucket, so choose a key without hot values.
    """
    (
        df.write.mode("overwrite")
        .option("path", path)
        .bucketBy(buckets, key)
        .sortBy(key)
        .format("parquet")
        .saveAsTable(table)
    )
    return df.sparkSession.table(table)


def refresh_by_year(
    spark: SparkSession, aggregate: DataFrame, path: str, years: list[int] | None = None
) -> DataFrame:
    """Overwrite the ``year`` partitions of a stored aggregate.

    With ``years`` only those partitions are recomputed; the filter reaches the
    scan, because ``year`` is a grouping key of the aggregate.
    """
    if years is not None:
        aggregate = aggregate.filter(F.col("year").isin(years))
    (
        aggregate.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic" if years is not None else "static")
        .partitionBy("year")
        .parquet(path)
    )
    return spark.read.parquet(path).select(*aggregate.columns)
