"""A stored monthly aggregate that follows the files of its source.

A refresh reads only files it has not counted yet.  Every file leaves a partial of its own:
sums by month, which are added up, and the numbers of its orders as bitmaps, which are
merged with OR, so an order whose lines lie in several files counts once.  A manifest says
which partials count.  A file that has gone, or has changed, takes its part back by leaving
the manifest; only months that some new or gone file touches are merged anew, from partials,
and only their years are written.

Layout under the root: ``manifest/version=N`` (one file list per refresh, the highest
counts), ``sums/batch=N`` and ``bitmaps/batch=N`` (partials of the files that refresh N
read), ``orders`` (the registry of order numbers), ``monthly/year=Y`` (the aggregate) and,
while a refresh runs, ``pending`` (the months it merges).  The manifest is written last: a
refresh that broke off is done again, and its months are merged again whatever happened to
its files meanwhile.  One refresh at a time may run on a root.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.operators import keys
from orderlens.session import freeze

FILE = ["path", "modified", "length"]
MONTH = ["year", "month"]
_MANIFEST = "path string, modified timestamp, length long, batch int, version int"
_BITMAPS = "path string, year int, month int, bucket long, bitmap binary, batch int"


def listing(spark: SparkSession, source: str) -> DataFrame:
    """Parquet files below ``source``, however deep: path, modified, length.  No file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    return files.load(source).select("path", F.col("modificationTime").alias("modified"), "length")


def _own_path() -> Column:
    """The path of the file a row comes from, as ``listing`` spells it."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


class MonthlyRefresh:
    """Monthly sums of ``columns`` and distinct orders over the files of one source.

    ``dated`` adds year, month and the columns that are summed to the rows of the source;
    ``finish`` turns (year, month, sums, orders) into the rows of the aggregate.
    """

    def __init__(
        self,
        root: str,
        schema: T.StructType,
        dated: Callable[[DataFrame], DataFrame],
        columns: list[str],
        finish: Callable[[DataFrame], DataFrame],
        order: str = "order_id",
    ):
        self.root, self.schema, self.dated, self.columns, self.finish, self.order = root, schema, dated, columns, finish, order

    def _read(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/{name}"
        return spark.read.schema(schema).parquet(path) if keys.exists(spark, path) else spark.createDataFrame([], schema)

    def manifest(self, spark: SparkSession) -> DataFrame:
        """Files that count now, with the batch that holds their partials."""
        every = self._read(spark, "manifest", _MANIFEST)
        last = every.agg(F.max("version")).first()[0]
        return every.where(F.col("version") == F.lit(last)).drop("version")

    def _sums(self, spark: SparkSession) -> DataFrame:
        kinds = ", ".join(f"{c} decimal(38,2)" for c in self.columns)
        return self._read(spark, "sums", f"path string, year int, month int, {kinds}, batch int")

    def refresh(self, spark: SparkSession, source: str) -> DataFrame:
        """Bring the aggregate up to the files that are there now, and return it."""
        now, before = freeze(listing(spark, source)), freeze(self.manifest(spark))
        version = (self._read(spark, "manifest", _MANIFEST).agg(F.max("version")).first()[0] or 0) + 1
        new = now.join(before, FILE, "left_anti")
        gone = before.join(now, FILE, "left_anti")
        paths = [r.path for r in new.select("path").collect()]  # names only, as any reader lists them
        if paths:
            self._count(spark, paths, version)
        counted = before.join(now, FILE, "left_semi").unionByName(new.withColumn("batch", F.lit(version)))
        counted = freeze(counted)
        sums = self._sums(spark)
        touched = sums.join(gone.select("path", "batch"), ["path", "batch"], "left_semi").select(*MONTH)
        touched = touched.unionByName(sums.where(F.col("batch") == version).select(*MONTH))
        touched = touched.unionByName(self._read(spark, "pending", "year int, month int"))
        touched = freeze(touched.distinct())
        touched.write.mode("overwrite").parquet(f"{self.root}/pending")
        self._merge(spark, counted, touched)
        counted.write.mode("overwrite").parquet(f"{self.root}/manifest/version={version}")
        keys.remove(spark, f"{self.root}/pending")
        return self.read(spark)

    def _count(self, spark: SparkSession, paths: list[str], batch: int) -> None:
        """Partials of these files, written as one batch."""
        rows = self.dated(spark.read.schema(self.schema).parquet(*paths).withColumn("path", _own_path()))
        added = [F.sum(c).cast("decimal(38,2)").alias(c) for c in self.columns]
        rows.groupBy("path", *MONTH).agg(*added).write.mode("overwrite").parquet(f"{self.root}/sums/batch={batch}")
        seen = freeze(rows.where(F.col(self.order).isNotNull()).select("path", *MONTH, self.order).distinct())
        members = seen.groupBy(self.order).agg(F.min(F.struct(*MONTH)).alias("_first"))
        numbers = keys.register(members, f"{self.root}/orders", "number", ["_first"])
        bucket = F.bitmap_bucket_number("number").alias("bucket")
        bits = F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bitmap")
        found = seen.join(numbers, self.order).groupBy("path", *MONTH, bucket).agg(bits)
        found.write.mode("overwrite").parquet(f"{self.root}/bitmaps/batch={batch}")

    def _merge(self, spark: SparkSession, counted: DataFrame, touched: DataFrame) -> None:
        """Months in ``touched`` from the partials that count, others as they are stored; whole years are written."""
        live = counted.select("path", "batch")
        years = touched.select("year").distinct()
        sums = self._sums(spark).join(touched, MONTH, "left_semi").join(live, ["path", "batch"], "left_semi")
        bits = self._read(spark, "bitmaps", _BITMAPS).join(touched, MONTH, "left_semi").join(live, ["path", "batch"], "left_semi")
        orders = bits.groupBy(*MONTH, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
        orders = orders.groupBy(*MONTH).agg(F.sum(F.bitmap_count("bitmap")).alias("orders"))
        merged = sums.groupBy(*MONTH).agg(*[F.sum(c).alias(c) for c in self.columns]).join(orders, MONTH, "left")
        merged = self.finish(merged.withColumn("orders", F.coalesce("orders", F.lit(0))))
        if keys.exists(spark, f"{self.root}/monthly"):
            stored = self._monthly(spark, merged.schema).join(years, "year", "left_semi")
            merged = merged.unionByName(stored.join(touched, MONTH, "left_anti"))
        merged = freeze(merged)
        emptied = years.join(merged, "year", "left_anti").collect()  # years that lost their last file
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(
            f"{self.root}/monthly"
        )
        for r in emptied:
            keys.remove(spark, f"{self.root}/monthly/year={r.year}")

    def _monthly(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{self.root}/monthly").select(*schema.names)

    def read(self, spark: SparkSession) -> DataFrame:
        kinds = ", ".join(f"{c} decimal(38,2)" for c in self.columns)
        empty = self.finish(spark.createDataFrame([], f"year int, month int, {kinds}, orders long"))
        return self._monthly(spark, empty.schema)
