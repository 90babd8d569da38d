"""Helpers that several corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderlens.session import shared_dir

#: Paths staged within the open ``scratch`` blocks, the innermost last.
_STAGED: ContextVar[tuple[list[str], ...]] = ContextVar("staged", default=())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns and no others.

    Names are matched exactly, and the first of several equal ones is taken, so
    that other columns of any name, also one that differs in case only, do no harm.
    """
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"c{df.columns.index(n)}").alias(n) for n in names))


def with_rest(df: DataFrame) -> DataFrame:
    """doc_id and text, and all columns by their places in one struct."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    own = [F.col(f"c{df.columns.index(n)}").alias(n) for n in ("doc_id", "text")]
    return plain.select(*own, F.struct(*plain.columns).alias("rest"))


def without_rest(df: DataFrame, columns: list[str], new_text: bool = False) -> DataFrame:
    """The columns of before; with ``new_text`` the text and its length follow ``text``."""
    out = [F.col(f"rest.c{i}").alias(f"c{i}") for i in range(len(columns))]
    if new_text:
        changed = ~F.col("text").eqNullSafe(F.col(f"rest.c{columns.index('text')}"))
        out[columns.index("text")] = F.col("text").alias(f"c{columns.index('text')}")
        if "n_chars" in columns:
            i = columns.index("n_chars")
            length = F.char_length("text").cast(df.schema["rest"].dataType[f"c{i}"].dataType)
            out[i] = F.when(changed, length).otherwise(F.col(f"rest.c{i}")).alias(f"c{i}")
    return df.select(*out).toDF(*columns)


def ship(spark: SparkSession) -> None:
    """Let local Python workers find this package; clusters get it with ``--py-files``."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{known}" if known else root


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new place in the folder that driver and executors share."""
    return f"{shared_dir(spark).rstrip('/')}/corpus-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}-{label}"


def stage(df: DataFrame, label: str, codec: str = "zstd", result: bool = False, **options: object) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files.

    What follows neither recomputes nor depends on the executors that made it.  A
    ``result`` outlives the ``scratch`` block that it is staged in.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    for staged in _STAGED.get()[: -1 if result else None][-1:]:
        staged.append(path)
    df.write.option("compression", codec).options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Files staged inside are deleted at the end, but for results; so no frame that reads them may be used later."""
    staged: list[str] = []
    before = _STAGED.set((*_STAGED.get(), staged))
    try:
        yield
    finally:
        _STAGED.reset(before)
        for path in staged:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Jobs run inside send at most so many rows at once to Python, whatever a partition holds."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, str(min(int(before), most) if int(before) > 0 else most))
        yield
    finally:
        spark.conf.set(key, before)


def running_starts(df: DataFrame, order: str, amount: str, out: str, block: int = 4096) -> DataFrame:
    """Add the sum of ``amount`` over all rows before each row, by distinct integers ``order``.

    Blocks of consecutive numbers are summed first; only block sums meet in one
    task, the rows of a block in another.
    """
    rows = df.withColumn("_block", F.floor(F.col(order) / block))
    sums = rows.groupBy("_block").agg(F.sum(amount).alias("_sum"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(sums, "_block")
    start = F.col("_before") + F.coalesce(F.sum(amount).over(inside), F.lit(0))
    return rows.withColumn(out, start.cast("long")).drop("_block", "_before")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def utf8_crc32(text: Column) -> Column:
    return F.crc32(F.encode(text, "UTF-8"))
