"""Session defaults and the shared folder for tables and checkpoints."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "orderlens", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the defaults above; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = DEFAULTS | {k.replace("__", "."): str(v) for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``; without that setting the
    session's warehouse folder holds a subfolder for it.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.shared"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def freeze(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and continue from there.

    Used where one aggregate feeds several later steps, so that the big scan
    behind it runs once and a lost executor does not bring it back.  The files
    are Parquet: later steps read only their columns and know the size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/frozen-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of the widest table that a task of a shuffle should hold at most, and MB it may be merged to.
ROWS_A_TASK, MB_A_TASK = 250_000, 16


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Jobs run inside have these settings; the session's own come back."""
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


@contextmanager
def spread(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside deal ``rows`` to so many tasks that the memory of one stays the same at any size.

    The number of shuffle partitions follows the rows, never below the session's own, and
    small partitions are merged only up to a size that is still small once rows are widened.
    Spark goes on to merge and split them by what it sees.  The session's settings come back.
    """
    wanted = {
        "spark.sql.shuffle.partitions": str(
            max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_TASK))
        ),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{MB_A_TASK}m",
    }
    with settings(spark, wanted):
        yield
