"""Order rollup, headline figures, breakdowns and the data behind the charts."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.functions import aggregates as A
from orderlens.functions import columns as C
from orderlens.operators.grouping import grouped

MEASURES = ["sales", "quantity", "discount", "profit", "profit_margin"]


def build_order_level(df: DataFrame, sequence: str = "line_seq") -> DataFrame:
    """One row per order: first non-missing attributes and summed measures.

    "First" follows ``sequence``, the position of the line in its file.  Lines
    are first folded by order and attributes, which leaves about one row per
    order, and only that is ordered by position.
    """
    attributes = ["order_date", "customer", "region", "segment"]
    folded = (
        df.filter(F.col("order_id").isNotNull())
        .groupBy("order_id", *attributes)
        .agg(
            F.min(sequence).alias("_seq"),
            F.sum("sales").alias("_sales"),
            F.sum("profit").alias("_profit"),
            F.count("product").alias("_lines"),
        )
    )
    first = [
        F.min_by(a, F.when(F.col(a).isNotNull(), F.col("_seq"))).alias(a) for a in attributes
    ]
    return folded.groupBy("order_id").agg(
        *first,
        A.total_or_zero("_sales").alias("order_sales"),
        A.total_or_zero("_profit").alias("order_profit"),
        F.sum("_lines").alias("n_lines"),
    )


def headline_kpis(df: DataFrame) -> DataFrame:
    """One row with the seven top-line figures."""
    sums = grouped(
        df,
        {
            "total_sales": A.total_or_zero("sales"),
            "total_profit": A.total_or_zero("profit"),
            "_discount": A.mean("discount"),
        },
        {"n_orders": "order_id", "n_customers": "customer_id"},
        [],
    )
    return sums.select(
        "total_sales",
        "total_profit",
        (A.ratio(F.col("total_profit"), F.col("total_sales")) * 100).alias("profit_margin_pct"),
        "n_orders",
        "n_customers",
        (F.col("_discount") * 100).alias("avg_discount_pct"),
        A.ratio(F.col("total_sales"), F.col("n_orders")).alias("avg_order_value"),
    )


def _finish_breakdown(sums: DataFrame, keys: list[str]) -> DataFrame:
    return sums.select(
        *keys,
        F.round("_sales", 2).alias("sales"),
        F.round("_profit", 2).alias("profit"),
        F.round("_discount", 2).alias("avg_discount_pct"),
        "orders",
        A.pct(F.col("_profit"), F.col("_sales")).alias("margin_pct"),
    )


def _breakdown_sums(grouped) -> DataFrame:
    return grouped.agg(
        A.total_or_zero("sales").alias("_sales"),
        A.total_or_zero("profit").alias("_profit"),
        A.mean_of_pct("discount_pct").alias("_discount"),
        F.count_distinct("order_id").alias("orders"),
    )


def breakdown(df: DataFrame, dimension: str) -> DataFrame:
    """Sales, profit, discount, distinct orders and margin by one dimension."""
    sums = _breakdown_sums(df.filter(F.col(dimension).isNotNull()).groupBy(dimension))
    return _finish_breakdown(sums, [dimension]).orderBy(F.col("sales").desc_nulls_last(), dimension)


def breakdowns(df: DataFrame, dimensions: list[str]) -> DataFrame:
    """Several breakdowns as (dimension, key, ...) from two scans.

    Sums are taken once per line, by all dimensions together, and folded per
    dimension afterwards.  Distinct orders cannot be folded that way; they come
    from a narrow second scan without any measure.
    """
    pairs = F.array(
        *[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("key")) for d in dimensions]
    )
    leaves = df.groupBy(*dimensions).agg(
        F.sum("sales").alias("_s"),
        F.sum("profit").alias("_p"),
        F.sum(F.col("discount_pct").cast("decimal(12,1)")).alias("_d"),
        F.count("discount_pct").alias("_n"),
    )
    sums = (
        leaves.select("_s", "_p", "_d", "_n", F.inline(pairs))
        .filter(F.col("key").isNotNull())
        .groupBy("dimension", "key")
        .agg(
            A.total_or_zero("_s").alias("_sales"),
            A.total_or_zero("_p").alias("_profit"),
            A.ratio(F.sum("_d"), F.sum("_n")).alias("_discount"),
        )
    )
    orders = (
        df.select("order_id", F.inline(pairs))
        .filter(F.col("key").isNotNull())
        .groupBy("dimension", "key")
        .agg(F.count_distinct("order_id").alias("orders"))
    )
    return _finish_breakdown(sums.join(orders, ["dimension", "key"]), ["dimension", "key"])


def _top(df: DataFrame, n: int, key: str) -> DataFrame:
    """The ``n`` largest keys with their revenue and the revenue of all lines.

    Lines without a key belong to the total only.  They are sorted last and cut
    off after the limit, so that ranking and total share one scan.
    """
    per = df.groupBy(key).agg(F.sum("sales").alias("_sum"))
    whole = per.agg(F.sum("_sum")).scalar()
    return (
        per.withColumn("_sales", F.coalesce(F.col("_sum"), F.lit(0)))
        .orderBy(F.col(key).isNull(), F.col("_sales").desc(), key)
        .limit(n)
        .filter(F.col(key).isNotNull())
        .select(key, F.col("_sales").cast("double").alias("sales"), whole.alias("_whole"))
    )


def top_customers(df: DataFrame, n: int = 10, key: str = "customer") -> DataFrame:
    """The ``n`` largest customers by revenue and their share of the total."""
    return _top(df, n, key).select(key, "sales", A.pct(F.col("sales"), F.col("_whole")).alias("pct_of_total"))


def top_share(df: DataFrame, n: int = 10, key: str = "customer") -> DataFrame:
    """Share of the top ``n``: sum of the rounded shares, and the exact share."""
    rounded = A.pct(F.col("sales"), F.col("_whole"))
    return _top(df, n, key).agg(
        F.round(F.sum(rounded), 1).alias("sum_of_rounded_pct"),
        A.pct(F.sum("sales"), F.max("_whole"), 4).alias("exact_pct"),
    )


def loss_lines(df: DataFrame) -> DataFrame:
    """Number of loss lines, of all lines, and the share."""
    counts = df.agg(F.count_if("is_loss").alias("loss_lines"), F.count("*").alias("total_lines"))
    return counts.withColumn("loss_pct", A.pct(F.col("loss_lines"), F.col("total_lines")))


def loss_by_product(df: DataFrame) -> DataFrame:
    """Profit of loss lines by product, worst first."""
    return (
        df.filter("is_loss")
        .filter(F.col("product").isNotNull())
        .groupBy("product")
        .agg(F.round(A.total("profit"), 0).alias("loss"))
        .orderBy("loss", "product")
    )


def discount_margin_corr(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.agg(F.round(A.safe_corr("discount", "profit_margin"), digits).alias("corr"))


def correlation_matrix(
    df: DataFrame, columns: list[str] | None = None, digits: int = 6
) -> DataFrame:
    """Long-form (x, y, r) for every ordered pair, from one aggregate."""
    columns = columns or MEASURES
    one = df.agg(*A.corr_matrix_exprs(columns))
    cells = []
    for a, b in combinations(columns, 2):
        r = F.col(f"`{a}|{b}`")
        cells += [(a, b, r), (b, a, r)]
    cells += [(a, a, F.col(f"`{a}|{a}`")) for a in columns]
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.round(r, digits).alias("r"))
            for a, b, r in cells
        ]
    )
    return one.select(F.inline(rows))


def monthly_sales(df: DataFrame) -> DataFrame:
    return (
        df.filter(F.col("year_month").isNotNull())
        .groupBy("year_month")
        .agg(A.total_or_zero("sales").alias("sales"))
        .orderBy("year_month")
    )


def hierarchy(df: DataFrame, parent: str = "region", child: str = "industry") -> DataFrame:
    """Sunburst nodes (id, label, parent, value): leaves and their parents.

    Leaves are summed first; the rollup then works on leaf totals only.
    """
    leaves = (
        df.filter(F.col(parent).isNotNull() & F.col(child).isNotNull())
        .groupBy(parent, child)
        .agg(F.sum("sales").alias("_sales"))
    )
    nodes = leaves.rollup(parent, child).agg(
        A.total("_sales").alias("value"), F.grouping_id().alias("_level")
    )
    leaf = F.col("_level") == 0
    return nodes.filter("_level < 3").select(
        F.when(leaf, F.concat_ws("/", parent, child)).otherwise(F.col(parent)).alias("id"),
        F.when(leaf, F.col(child)).otherwise(F.col(parent)).alias("label"),
        F.when(leaf, F.col(parent)).otherwise("").alias("parent"),
        "value",
    )


def scatter_points(df: DataFrame) -> DataFrame:
    """Per line: discount, margin and profit with the hover fields."""
    return df.select(
        "discount_pct",
        (F.col("profit_margin") * 100).alias("margin_pct"),
        F.col("profit").cast("double").alias("profit"),
        "segment",
        "product",
        "customer",
    )


def scatter_bins(df: DataFrame, margin_step: float = 5.0) -> DataFrame:
    """The scatter as counts per discount percent, margin bin and segment."""
    low = (F.floor(F.col("profit_margin") * 100 / margin_step) * margin_step).cast("double")
    return (
        df.withColumn("margin_bin", low)
        .groupBy("discount_pct", "margin_bin", "segment")
        .agg(F.count("*").alias("n_lines"), A.total("profit").alias("profit"))
    )


def margin_by_bucket(df: DataFrame) -> DataFrame:
    """Margin per discount interval; discounts outside (-0.01, 1] are left out."""
    cut = df.withColumn("discount_bucket", C.discount_bucket_cut()).filter("discount_bucket is not null")
    sums = cut.groupBy("discount_bucket").agg(F.sum("sales").alias("s"), F.sum("profit").alias("p"))
    return sums.select(
        "discount_bucket",
        C.bucket_order().alias("bucket_order"),
        (A.ratio(F.col("p"), F.col("s")) * 100).alias("margin_pct"),
    ).orderBy("bucket_order")
