"""Order lines from the TPC-H-like tables the tests and the bench run on.

Those tables carry no profit and small discounts, so discount is widened and
profit is derived from the product's base margin.  The fixed numbers below are
part of that mapping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.operators.features import clean_layout, engineer_features


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_lines(spark: SparkSession, sf_dir: str, one: int = 0, of: int = 1) -> DataFrame:
    """Flat lines without engineered columns; slice ``one`` ``of`` so many, dealt by order, or all.

    Customers join at order grain, before the lines.  Lines meet parts while
    they are still narrow, and orders last.  Lines and orders grow together, so
    that join is a sort-merge join whatever the size, and Spark splits skewed
    partitions of it; customers and parts are broadcast only if their files are
    small.  Nations and regions are fixed lists of 25 and 5 rows; they and all
    texts made of others come after that join, so its rows stay narrow.
    """
    def sliced(df: DataFrame, key: str) -> DataFrame:
        return df if of == 1 else df.where(F.pmod(F.xxhash64(key), F.lit(of)) == one)

    places = (
        table(spark, sf_dir, "nation")
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", "n_name", "r_name")
    )
    orders = (
        sliced(table(spark, sf_dir, "orders"), "o_orderkey")
        .select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("order_date"))
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            "o_orderkey",
            "order_date",
            "c_custkey",
            "c_name",
            "c_nationkey",
            "c_mktsegment",
            F.when(F.col("c_acctbal") < 4500, "SMB")
            .when(F.col("c_acctbal") < 6500, "Strategic")
            .otherwise("Enterprise")
            .alias("segment"),
        )
    )
    # The base margin depends on the product alone, so it is worked out per part.
    brand_number = F.substring("p_brand", 7, 8).cast("int")
    part = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.col("p_brand").alias("product"),
        (((brand_number * 7) % 40 - 2).cast("decimal(6,2)") / 100).cast("decimal(6,4)").alias("base"),
    )
    cut = F.col("l_discount").cast("decimal(4,2)") * 5
    return (
        sliced(table(spark, sf_dir, "lineitem"), "l_orderkey")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .drop("l_partkey", "p_partkey")
        .join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        .withColumn("discount", cut.cast("decimal(5,4)"))
        .withColumn(
            "sales", (F.col("l_extendedprice").cast("decimal(12,2)") * (1 - cut)).cast("decimal(12,2)")
        )
        .withColumn(
            "profit",
            (F.col("sales") * (F.col("base") - (F.col("discount") * F.lit("0.6").cast("decimal(2,1)")).cast("decimal(6,4)")))
            .cast("decimal(12,2)"),
        )
        .select(
            F.col("l_orderkey").alias("order_id"),
            "order_date",
            F.concat(F.lit("Contact of "), "c_name").alias("contact_name"),
            F.col("n_name").alias("country"),
            F.concat("n_name", F.lit("#"), (F.col("c_custkey") % 4).cast("string")).alias("city"),
            F.col("r_name").alias("region"),
            F.concat("r_name", F.lit("-"), (F.col("n_nationkey") % 2).cast("string")).alias("subregion"),
            F.col("c_name").alias("customer"),
            F.col("c_custkey").alias("customer_id"),
            F.col("c_mktsegment").alias("industry"),
            "segment",
            "product",
            "sales",
            F.col("l_quantity").cast("int").alias("quantity"),
            "discount",
            "profit",
            F.col("l_linenumber").cast("long").alias("line_seq"),
        )
    )


def clean_lines(spark: SparkSession, sf_dir: str, one: int = 0, of: int = 1) -> DataFrame:
    """The 27 clean columns plus ``line_seq``, the position within the order; all lines or a slice of them."""
    return clean_layout(engineer_features(order_lines(spark, sf_dir, one, of)), extra=("line_seq",))
