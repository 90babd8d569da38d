"""Queries behind the dashboard visuals, over the flat clean lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.functions import aggregates as A
from orderlens.functions import columns as C
from orderlens.operators import kpis
from orderlens.operators.measures import NONE, Slicers, cumulative_share, evaluate
from orderlens.plans.library import c6_discount_margin, pareto_columns

CARDS = ["total_sales", "total_profit", "profit_margin", "total_orders", "avg_order_value"]


def kpi_cards(lines: DataFrame, slicers: Slicers = NONE) -> DataFrame:
    return evaluate(lines, CARDS, slicers=slicers)


def monthly_trend(lines: DataFrame, slicers: Slicers = NONE) -> DataFrame:
    """Sales and profit by month-year label, with its sort key."""
    per = evaluate(lines, ["total_sales", "total_profit"], ["year", "month"], slicers)
    return per.select(
        F.date_format(F.make_date("year", "month", F.lit(1)), "MMM yyyy").alias("month_year"),
        (F.col("year") * 100 + F.col("month")).alias("year_month_sort"),
        "total_sales",
        "total_profit",
    ).orderBy("year_month_sort")


def region_bars(lines: DataFrame, slicers: Slicers = NONE) -> DataFrame:
    return evaluate(lines, ["total_sales", "total_profit"], ["region"], slicers)


def product_profit(lines: DataFrame, slicers: Slicers = NONE) -> DataFrame:
    """Profit by product, worst first, with the flag that colours the bar."""
    return (
        evaluate(lines, ["total_profit"], ["product"], slicers)
        .withColumn("is_loss", C.is_loss("total_profit"))
        .orderBy("total_profit", "product")
    )


def top_customers(lines: DataFrame, n: int = 10, slicers: Slicers = NONE) -> DataFrame:
    return kpis.top_customers(slicers.apply(lines), n)


def discount_columns(lines: DataFrame, slicers: Slicers = NONE) -> DataFrame:
    return c6_discount_margin(slicers.apply(lines))


def discount_profit_scatter(lines: DataFrame, slicers: Slicers = NONE) -> DataFrame:
    return evaluate(lines, ["avg_discount", "total_profit"], ["segment", "product"], slicers)


def product_table(lines: DataFrame, slicers: Slicers = NONE) -> DataFrame:
    """Sales, profit, margin, and the margin's place on a min-to-max colour scale.

    ``colour`` is 0 at the smallest margin, 1 at the largest, 0.5 halfway.
    """
    per = evaluate(lines, ["total_sales", "total_profit", "profit_margin"], ["product"], slicers)
    lo, hi = per.agg(F.min("profit_margin")).scalar(), per.agg(F.max("profit_margin")).scalar()
    return per.withColumn("colour", F.round(F.try_divide(F.col("profit_margin") - lo, hi - lo), 6))


def _matrix(lines: DataFrame, row: str, column: str, sums: list[str]) -> DataFrame:
    """Sums by row and column key, by each of them, and over all, one line a cell.

    ``<key>_total`` marks the lines that hold a total over that key, whatever the
    key's values are; a null key is a value like any other.  Cells are summed
    first, so the totals are made of cell-sized data.
    """
    cells = lines.groupBy(row, column).agg(*[F.sum(c).alias(c) for c in sums])
    return cells.cube(row, column).agg(
        (F.grouping(row) == 1).alias(f"{row}_total"),
        (F.grouping(column) == 1).alias(f"{column}_total"),
        *[F.sum(c).alias(c) for c in sums],
    )


def wide(matrix: DataFrame, row: str, column: str, values: list[str], measure: str) -> DataFrame:
    """A matrix's cells with one column for each of the named values, for those who want it wide."""
    cells = matrix.filter(~F.col(f"{row}_total") & ~F.col(f"{column}_total"))
    return cells.groupBy(row).pivot(column, values).agg(F.first(measure))


def product_region_matrix(lines: DataFrame, slicers: Slicers = NONE) -> DataFrame:
    """Profit by product and region, with totals on both sides."""
    cells = _matrix(slicers.apply(lines), "product", "region", ["profit"])
    return cells.withColumn("profit", F.col("profit").cast("double"))


def industry_segment_matrix(lines: DataFrame, slicers: Slicers = NONE) -> DataFrame:
    """Sales and margin by industry and segment, with totals on both sides."""
    cells = _matrix(slicers.apply(lines), "industry", "segment", ["sales", "profit"])
    margin = A.ratio(F.col("profit"), F.col("sales")).alias("margin")
    return cells.select(
        "industry", "segment", "industry_total", "segment_total", F.col("sales").cast("double").alias("sales"), margin
    )


def pareto_chart(lines: DataFrame, n: int = 15, slicers: Slicers = NONE) -> DataFrame:
    """The ``n`` largest customers with cumulative share of all selected sales."""
    ranked = pareto_columns(cumulative_share(lines, "customer", slicers=slicers), "customer")
    return ranked.orderBy(F.col("revenue").desc_nulls_last(), "customer").limit(n)


def customer_table(lines: DataFrame, slicers: Slicers = NONE) -> DataFrame:
    return evaluate(lines, CARDS, ["customer"], slicers)


def _detail(lines: DataFrame, key: str, value: str | None, listing: list[str]) -> dict[str, DataFrame]:
    scope = lines if value is None else lines.filter(F.col(key) == value)
    return {
        "kpis": evaluate(scope, CARDS, [key]),
        "monthly": evaluate(scope, ["total_sales"], [key, "year", "month"]),
        "orders": scope.groupBy(key, *listing).agg(
            A.total("sales").alias("sales"),
            A.total("profit").alias("profit"),
            F.sum("quantity").alias("quantity"),
            F.count("*").alias("n_lines"),
        ),
    }


def customer_detail(lines: DataFrame, customer: str | None = None) -> dict[str, DataFrame]:
    """Drill-through on one customer, or on each of them: cards, months, orders."""
    return _detail(lines, "customer", customer, ["order_id", "order_date", "product"])


def product_detail(lines: DataFrame, product: str | None = None) -> dict[str, DataFrame]:
    """Drill-through on one product, or on each of them."""
    return _detail(lines, "product", product, ["order_id", "order_date", "customer"])
