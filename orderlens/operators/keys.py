"""Lasting surrogate keys: a stored registry of natural keys and their numbers.

A load adds the members that the registry doesn't hold yet and never changes a number it
has given.  New members are numbered after the last one in the order of their natural
keys: they are dealt to ranges, counted per range, and shifted by the counts of the ranges
before theirs, so no task sees more than its range and numbers are gapless 64-bit integers,
the same however the rows are partitioned.

A registry is a folder of Parquet batches, one per load that brought new members.  A batch
that was not finished is not seen and is written anew.  One load at a time may add to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.operators.joins import null_safe_join
from orderlens.operators.prefix import sums_before
from orderlens.session import freeze


def number_rows(df: DataFrame, keys: list[str], name: str, buckets: int | None = None, after: int = 0) -> DataFrame:
    """``df`` with gapless ids from ``after`` + 1, in the order of ``keys``; ``buckets`` is the number of ranges."""
    if buckets is not None and buckets < 1:
        raise ValueError("rows are dealt to one range at least")
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = freeze(df.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    shifts = sums_before(counts, "_part", ["_n"], [], n).withColumnRenamed("_at", "_part")
    inside = Window.partitionBy("_part").orderBy(*keys)
    numbered = dealt.withColumn("_pos", F.row_number().over(inside)).join(shifts, "_part")
    number = F.lit(after).cast("long") + F.col("_before__n") + F.col("_pos")
    return numbered.withColumn(name, number.cast("long")).select(name, *df.columns)


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, store = _place(spark, path)
    return store.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a stored folder or file."""
    place, store = _place(spark, path)
    store.delete(place, True)


def read(spark: SparkSession, path: str, members: T.StructType, name: str) -> DataFrame | None:
    """(name, natural key, batch) of all members so far; None before the first load."""
    if not exists(spark, path):
        return None
    schema = T.StructType([T.StructField(name, T.LongType()), *members.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(schema).parquet(path)


def register(members: DataFrame, path: str, name: str, order: list[str] | None = None) -> DataFrame:
    """Add the new ones of ``members`` (distinct natural keys; null is a key like any other).

    ``order`` names further columns of ``members`` by which new ones are numbered first, so
    that members met together get numbers close together; they are not kept.  Returns
    (name, natural key) of all members the registry holds then.
    """
    spark, first = members.sparkSession, order or []
    keys = [c for c in members.columns if c not in first]
    natural = members.select(*keys).schema
    held = read(spark, path, natural, name)
    new, last, batch = members, 0, 0
    if held is not None:
        top = held.agg(F.max(name).alias("last"), F.max("batch").alias("batch")).first()
        last, batch = top["last"] or 0, top["batch"] or 0
        new = null_safe_join(members, held.select(*keys), keys, "left_anti")
    numbered = number_rows(new, [*first, *keys], name, after=last)
    if held is None or not numbered.isEmpty():
        numbered.select(name, *keys).write.mode("overwrite").parquet(f"{path}/batch={batch + 1}")
    return read(spark, path, natural, name).drop("batch")
