"""Query library over the star schema.

Additive figures are first summed by surrogate key, so the fact is reduced
before it meets a dimension; a hot key collapses on the map side and the join
works on key-sized data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.functions import aggregates as A
from orderlens.functions import columns as C
from orderlens.operators.joins import null_safe_join
from orderlens.operators.measures import concentration
from orderlens.operators.star import Star
from orderlens.session import freeze
from orderlens.sources.incremental import MonthlyRefresh
from orderlens.sources.tables import refresh_by_year


def _by(star: Star, *attributes: str) -> DataFrame:
    """Summed sales, profit, discount and line counts per dimension attributes."""
    homes = {
        "customer_key": star.dim_customer,
        "product_key": star.dim_product,
        "geography_key": star.dim_geography,
        "date_key": star.dim_date,
    }
    used = {k: [a for a in attributes if a in d.columns] for k, d in homes.items()}
    used = {k: cols for k, cols in used.items() if cols}
    out = star.fact_sales.groupBy(*used).agg(
        F.sum("sales").alias("_sales"),
        F.sum("profit").alias("_profit"),
        F.sum("discount").alias("_discount"),
        F.count("discount").alias("_discounts"),
    )
    for key, cols in used.items():
        out = out.join(homes[key].select(key, *cols), key)
    return out.groupBy(*attributes).agg(
        *[F.sum(c).alias(c) for c in ("_sales", "_profit", "_discount", "_discounts")]
    )


def _money(c: str, name: str):
    return F.round(F.col(c).cast("double"), 2).alias(name)


def _margin():
    return A.pct(F.col("_profit"), F.col("_sales")).alias("margin_pct")


def a1_headline_kpis(star: Star) -> DataFrame:
    sums = star.fact_sales.agg(
        F.sum("sales").alias("_sales"),
        F.sum("profit").alias("_profit"),
        F.count_distinct("order_id").alias("total_orders"),
        A.mean("discount").alias("_discount"),
    )
    return sums.select(
        _money("_sales", "total_sales"),
        _money("_profit", "total_profit"),
        A.pct(F.col("_profit"), F.col("_sales")).alias("profit_margin_pct"),
        "total_orders",
        F.round(A.ratio(F.col("_sales"), F.col("total_orders")), 2).alias("avg_order_value"),
        F.round(F.col("_discount") * 100, 1).alias("avg_discount_pct"),
    )


def a2_region_sales(star: Star) -> DataFrame:
    return (
        _by(star, "region")
        .select("region", _money("_sales", "sales"), _money("_profit", "profit"), _margin())
        .orderBy(F.col("sales").desc_nulls_first(), "region")
    )


def a3_top_customers(star: Star, n: int = 10) -> DataFrame:
    """Top ``n`` by revenue with distinct orders.

    Orders are folded per customer key before names are looked up; names are
    then counted over folded orders, since two keys may carry one name.
    """
    folded = star.fact_sales.groupBy("customer_key", "order_id").agg(F.sum("sales").alias("_sales"))
    named = folded.join(star.dim_customer.select("customer_key", "customer_name"), "customer_key")
    return (
        named.groupBy("customer_name")
        .agg(F.sum("_sales").alias("_sales"), F.count_distinct("order_id").alias("orders"))
        .select("customer_name", _money("_sales", "revenue"), "orders")
        .orderBy(F.col("revenue").desc_nulls_first(), "customer_name")
        .limit(n)
    )


def b1_product_health(star: Star) -> DataFrame:
    return (
        _by(star, "product_name")
        .select(
            "product_name",
            _money("_sales", "sales"),
            _money("_profit", "profit"),
            _margin(),
            C.health_status(F.col("_profit"), F.col("_sales")).alias("status"),
        )
        .orderBy(F.col("margin_pct").asc_nulls_last(), "product_name")
    )


def b2_loss_products(star: Star) -> DataFrame:
    return (
        _by(star, "product_name")
        .filter("_profit < 0")
        .select("product_name", _money("_profit", "total_profit"))
        .orderBy("total_profit", "product_name")
    )


def b3_segments_above_average_discount(star: Star) -> DataFrame:
    """Segments whose mean discount exceeds the mean over all fact rows."""
    everyone = star.fact_sales.agg(A.mean("discount")).scalar()
    own = A.ratio(F.col("_discount"), F.col("_discounts"))
    return (
        _by(star, "segment")
        .filter(own > everyone)
        .select("segment", F.round(own * 100, 1).alias("avg_discount_pct"))
        .orderBy(F.col("avg_discount_pct").desc(), "segment")
    )


def b4_industry_segment(star: Star) -> DataFrame:
    return (
        _by(star, "industry", "segment")
        .select("industry", "segment", _money("_sales", "sales"), _margin())
        .orderBy("industry", F.col("sales").desc_nulls_first(), "segment")
    )


def b5_monthly_trend(star: Star) -> DataFrame:
    return (
        _by(star, "year", "month", "month_name")
        .select("year", "month", "month_name", _money("_sales", "sales"))
        .orderBy("year", "month")
    )


def customer_revenue(star: Star, *extra: str) -> DataFrame:
    return _by(star, *extra, "customer_name").select(
        *extra, "customer_name", F.col("_sales").alias("revenue")
    )


def pareto_columns(ranked: DataFrame, *names: str) -> DataFrame:
    return ranked.select(
        *names,
        F.round(F.col("revenue").cast("double"), 2).alias("revenue"),
        A.pct(F.col("revenue"), F.col("whole")).alias("pct_of_total"),
        A.pct(F.col("cumulative"), F.col("whole")).alias("cumulative_pct"),
    )


def c1_pareto(star: Star, buckets: int = 0) -> DataFrame:
    """Revenue share and cumulative share per customer, largest first."""
    ranked = concentration(customer_revenue(star), buckets=buckets)
    return pareto_columns(ranked, "customer_name").orderBy(
        F.col("revenue").desc_nulls_first(), "customer_name"
    )


def c2_best_product_by_region(star: Star) -> DataFrame:
    """Best seller of each region, ties kept.

    The rank filter is applied before the shuffle as well, so each task sends
    only its own best per region.
    """
    best = Window.partitionBy("region").orderBy(F.col("_sales").desc_nulls_first())
    return (
        _by(star, "region", "product_name")
        .withColumn("_rank", F.rank().over(best))
        .filter("_rank = 1")
        .select("region", "product_name", _money("_sales", "sales"))
        .orderBy(F.col("sales").desc_nulls_first(), "region", "product_name")
    )


def monthly(star: Star) -> DataFrame:
    return _by(star, "year", "month").select("year", "month", F.col("_sales").alias("sales"))


def c3_month_over_month(star: Star) -> DataFrame:
    """Change against the previous month that has sales; the window is month-sized."""
    w = Window.orderBy(F.col("year").asc_nulls_last(), F.col("month").asc_nulls_last())
    lagged = monthly(star).withColumn("_prev", F.lag("sales").over(w))
    change = F.col("sales") - F.col("_prev")
    return lagged.select(
        "year",
        "month",
        F.round(F.col("sales").cast("double"), 2).alias("sales"),
        F.round(change.cast("double"), 2).alias("mom_change"),
        A.pct(change, F.col("_prev")).alias("mom_pct"),
    ).orderBy("year", "month")


def c4_share_of_industry(star: Star) -> DataFrame:
    """Each customer's share of the revenue of its industry.

    Industry totals are joined back instead of windowed, so an industry with
    very many customers stays spread over the cluster.
    """
    per = freeze(customer_revenue(star, "industry"))
    totals = per.groupBy("industry").agg(F.sum("revenue").alias("_total"))
    return (
        null_safe_join(per, totals, ["industry"])
        .select(
            "industry",
            "customer_name",
            F.round(F.col("revenue").cast("double"), 2).alias("revenue"),
            A.pct(F.col("revenue"), F.col("_total")).alias("pct_of_industry"),
        )
        .orderBy("industry", F.col("revenue").desc_nulls_first(), "customer_name")
    )


def c5_year_to_date(star: Star) -> DataFrame:
    w = Window.partitionBy("year").orderBy(F.col("month").asc_nulls_last())
    return (
        monthly(star)
        .withColumn("_ytd", F.sum("sales").over(w))
        .select(
            "year",
            "month",
            F.round(F.col("sales").cast("double"), 2).alias("monthly_sales"),
            F.round(F.col("_ytd").cast("double"), 2).alias("running_total_ytd"),
        )
        .orderBy("year", "month")
    )


def c6_discount_margin(lines: DataFrame) -> DataFrame:
    """Lines, sales, profit and margin per discount bucket; works on fact or flat lines."""
    sums = (
        lines.withColumn("discount_bucket", C.discount_bucket())
        .groupBy("discount_bucket")
        .agg(
            F.count("*").alias("line_count"), F.sum("sales").alias("_sales"), F.sum("profit").alias("_profit")
        )
    )
    return sums.select(
        "discount_bucket", "line_count", _money("_sales", "sales"), _money("_profit", "profit"), _margin()
    ).orderBy("discount_bucket")


def d1_sales_enriched(star: Star) -> DataFrame:
    """Fact with all dimensions, margin percent and loss flag, 19 columns."""
    return (
        star.fact_sales.join(star.dim_date, "date_key")
        .join(star.dim_customer, "customer_key")
        .join(star.dim_product, "product_key")
        .join(star.dim_geography, "geography_key")
        .select(
            "sale_id",
            "order_id",
            "full_date",
            "year",
            "quarter",
            "month_name",
            "customer_name",
            "industry",
            "segment",
            "product_name",
            "region",
            "subregion",
            "country",
            "sales",
            "quantity",
            "discount",
            "profit",
            C.row_margin_pct().alias("profit_margin_pct"),
            C.is_loss().alias("is_loss"),
        )
    )


def d2_monthly_kpis(star: Star) -> DataFrame:
    dated = star.fact_sales.join(star.dim_date.select("date_key", "year", "month"), "date_key")
    return (
        dated.groupBy("year", "month")
        .agg(
            F.sum("sales").alias("_sales"),
            F.sum("profit").alias("_profit"),
            F.count_distinct("order_id").alias("orders"),
        )
        .select(
            "year", "month", _money("_sales", "sales"), _money("_profit", "profit"), _margin(), "orders"
        )
    )


def e1_region_kpis(star: Star, region: str) -> DataFrame:
    """(metric, value) of one region from a single scan; an unknown region gives nulls and 0."""
    keys = star.dim_geography.filter(F.col("region") == region).select("geography_key")
    sums = star.fact_sales.join(keys, "geography_key", "left_semi").agg(
        F.sum("sales").alias("s"), F.sum("profit").alias("p"), F.count_distinct("order_id").alias("n")
    )
    rows = [
        ("total_sales", F.round(F.col("s").cast("double"), 2)),
        ("total_profit", F.round(F.col("p").cast("double"), 2)),
        ("margin_pct", A.pct(F.col("p"), F.col("s"))),
        ("orders", F.col("n").cast("double")),
    ]
    return sums.select(
        F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in rows]))
    )


def region_kpis_all(star: Star) -> DataFrame:
    """The same four metrics for every region: (region, metric, value)."""
    keyed = star.fact_sales.groupBy("geography_key", "order_id").agg(
        F.sum("sales").alias("s"), F.sum("profit").alias("p")
    )
    sums = (
        keyed.join(star.dim_geography.select("geography_key", "region"), "geography_key")
        .groupBy("region")
        .agg(
            F.sum("s").cast("double").alias("total_sales"),
            F.sum("p").cast("double").alias("total_profit"),
            A.pct(F.sum("p"), F.sum("s")).alias("margin_pct"),
            F.count_distinct("order_id").cast("double").alias("orders"),
        )
    )
    return sums.unpivot(
        ["region"], ["total_sales", "total_profit", "margin_pct", "orders"], "metric", "value"
    ).withColumn("value", F.round("value", 2))


REGION_FUNCTION = """
CREATE OR REPLACE TEMPORARY FUNCTION get_region_kpis(p_region STRING)
RETURNS TABLE (metric STRING, value DOUBLE)
RETURN
  SELECT t.metric, t.value
  FROM (SELECT CAST(sum(f.sales) AS DOUBLE) AS s, CAST(sum(f.profit) AS DOUBLE) AS p,
               count(DISTINCT f.order_id) AS n
        FROM fact_sales f LEFT SEMI JOIN
             (SELECT geography_key FROM dim_geography WHERE region = p_region) g
             ON f.geography_key = g.geography_key) k
  LATERAL VIEW inline(array(
    named_struct('metric', 'total_sales', 'value', round(k.s, 2)),
    named_struct('metric', 'total_profit', 'value', round(k.p, 2)),
    named_struct('metric', 'margin_pct', 'value', round(try_divide(k.p * 100, k.s), 1)),
    named_struct('metric', 'orders', 'value', CAST(k.n AS DOUBLE)))) t AS metric, value
"""


def register_views(spark: SparkSession, star: Star) -> None:
    """Temp views of the tables and the two views, and the table function."""
    star.register()
    d1_sales_enriched(star).createOrReplaceTempView("vw_sales_enriched")
    d2_monthly_kpis(star).createOrReplaceTempView("vw_monthly_kpis")
    spark.sql(REGION_FUNCTION)


def monthly_refresh(root: str, fact: T.StructType) -> MonthlyRefresh:
    """The monthly view as a table that follows the files of a fact table with this schema."""

    def dated(rows: DataFrame) -> DataFrame:
        year, month = F.floor(F.col("date_key") / 10000), F.floor(F.col("date_key") / 100) % 100
        return rows.withColumns({"year": year.cast("int"), "month": month.cast("int")}).where("date_key IS NOT NULL")

    def finish(sums: DataFrame) -> DataFrame:
        named = sums.withColumnsRenamed({"sales": "_sales", "profit": "_profit"})
        return named.select("year", "month", _money("_sales", "sales"), _money("_profit", "profit"), _margin(), "orders")

    return MonthlyRefresh(root, fact, dated, ["sales", "profit"], finish)


def refresh_monthly_kpis(
    spark: SparkSession, star: Star, path: str, years: list[int] | None = None
) -> DataFrame:
    """Store the monthly view as a table; with ``years`` only those are rebuilt."""
    scope = star
    if years is not None:
        fact = star.fact_sales
        if "sale_year" in fact.columns:
            fact = fact.filter(F.col("sale_year").isin(years))
        scope = Star(fact, star.dim_date, star.dim_customer, star.dim_product, star.dim_geography)
    return refresh_by_year(spark, d2_monthly_kpis(scope), path, years)
