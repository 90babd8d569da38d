"""Measure layer: named measures for any grouping, under any filters.

``evaluate`` answers one visual: the slicers become a filter, the axis becomes a
GROUP BY, and all sums come out of a single aggregate; each further distinct count
has a narrow one of its own, so that no row is copied.  Measures that
change their context (share of total, rank, cumulative share, time shifts) are
computed from that small grouped result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions import aggregates as A
from orderlens.operators import timelines
from orderlens.operators.grouping import grouped
from orderlens.operators.prefix import running_totals
from orderlens.operators.slicers import NONE, Slicers
from orderlens.session import freeze


#: Distinct counts and the columns they count.
COUNTED = {"orders": "order_id", "customers": "customer_id"}


def bases() -> dict[str, Column]:
    """Sums every plain measure is made of, besides the distinct counts."""
    return {
        "sales": F.sum("sales"),
        "profit": F.sum("profit"),
        "quantity": F.sum("quantity"),
        "discount": F.sum("discount"),
        "discounts": F.count("discount"),
        "loss_sales": F.sum(F.when(F.col("profit") < 0, F.col("sales"))),
    }


@dataclass(frozen=True)
class Measure:
    needs: tuple[str, ...]
    value: object  # function of the base columns


def _b(name: str) -> Column:
    return F.col(f"_{name}")


MEASURES: dict[str, Measure] = {
    "total_sales": Measure(("sales",), lambda: _b("sales").cast("double")),
    "total_profit": Measure(("profit",), lambda: _b("profit").cast("double")),
    "total_orders": Measure(("orders",), lambda: _b("orders")),
    "total_quantity": Measure(("quantity",), lambda: _b("quantity")),
    "total_customers": Measure(("customers",), lambda: _b("customers")),
    "profit_margin": Measure(("profit", "sales"), lambda: A.ratio(_b("profit"), _b("sales"))),
    "avg_order_value": Measure(("sales", "orders"), lambda: A.ratio(_b("sales"), _b("orders"))),
    "avg_discount": Measure(("discount", "discounts"), lambda: A.ratio(_b("discount"), _b("discounts"))),
    "loss_making_sales": Measure(("loss_sales",), lambda: _b("loss_sales").cast("double")),
}


def evaluate(
    df: DataFrame,
    measures: Sequence[str],
    by: Sequence[str] = (),
    slicers: Slicers = NONE,
    share_of_total: bool = False,
) -> DataFrame:
    """Plain measures by any keys under any slicers; optionally the share of total.

    The share divides by the total under the same slicers, ignoring the axis.
    """
    needed = bases_of(measures, share_of_total)
    sums = {f"_{b}": c for b, c in bases().items() if b in needed}
    distinct = {f"_{b}": c for b, c in COUNTED.items() if b in needed}
    return finish(grouped(slicers.apply(df), sums, distinct, by), measures, by, share_of_total)


def bases_of(measures: Sequence[str], share_of_total: bool = False) -> set[str]:
    return {b for m in measures for b in MEASURES[m].needs} | ({"sales"} if share_of_total else set())


def finish(found: DataFrame, measures: Sequence[str], by: Sequence[str], share_of_total: bool) -> DataFrame:
    """Measures from their bases, one row per group."""
    out = [MEASURES[m].value().alias(m) for m in measures]
    if share_of_total:
        found = freeze(found)  # read twice: for the rows and for the total
        whole = found.agg(F.sum("_sales")).scalar()
        out.append(A.ratio(_b("sales"), whole).alias("pct_of_total_sales"))
    return found.select(*by, *out)


# -- time intelligence -------------------------------------------------------


def time_measures(
    lines: DataFrame, calendar: DataFrame, by: Sequence[str] = (), slicers: Slicers = NONE
) -> DataFrame:
    """Monthly sales with last year, YoY, YTD, MoM and running total.

    One row per selected calendar month (and per key combination in ``by``).  Shifts
    follow calendar months, so a month without sales counts; YTD and running total carry
    forward past the last month with data.  Shifts and YTD look beyond the date slicers,
    the running total starts at the first selected day.  For many keys take
    ``timelines.intervals``, which this expands: its rows follow the sales.
    """
    found = timelines.expand(timelines.intervals(lines, calendar, by, slicers))
    columns = [F.year("first").alias("year"), F.month("first").alias("month")]
    return found.select(*by, *columns, *timelines.MEASURES)


def daily_time_measures(
    lines: DataFrame, calendar: DataFrame, by: Sequence[str] = (), slicers: Slicers = NONE
) -> DataFrame:
    """Day-grain sales, last year, YTD and running total of the selected days.

    29 February looks back at 28 February.  As with months, ``timelines.intervals`` holds
    the same values in rows that follow the sales.
    """
    wanted = ["total_sales", "sales_ly", "sales_ytd", "running_total"]
    found = timelines.intervals(lines, calendar, by, slicers, wanted, timelines.DAY)
    return timelines.expand(found, timelines.DAY).withColumnRenamed("first", "date").select(*by, "date", *wanted)


# -- rank and concentration --------------------------------------------------


def product_rank(
    lines: DataFrame, products: DataFrame, by: Sequence[str] = (), slicers: Slicers = NONE
) -> DataFrame:
    """Rank of each product by sales among all products, best first.

    Other slicers hold, a slicer on the product does not narrow the ranking but
    hides products from the result.  ``products`` lists all product names; one
    without sales ranks as zero.  Without ``by`` such products appear in the
    result too.  Ranks come from running counts, not from a global sort.
    """
    keys = list(by)
    wide = slicers.without("product").apply(lines).filter(F.col("product").isNotNull())
    sold = wide.groupBy(*keys, "product").agg(F.sum("sales").alias("_sales"))
    catalog = products.select("product").distinct()
    if not keys:
        sold = catalog.join(sold, "product", "left")
    amounts = sold.withColumns(
        {
            "_amount": F.coalesce("_sales", F.lit(0)).cast("decimal(38,2)"),
            "_one": F.lit(1).cast("long"),
        }
    )
    ranked = running_totals(amounts, "_amount", {"_above": "_one"}, keys, inclusive=False)
    rank = F.col("_above") + 1
    if keys:
        # Products absent from a group count as zero and outrank negative sales.
        listed = catalog.agg(F.count("*")).scalar()
        rank = rank + F.when(F.col("_amount") < 0, listed - F.col("_above_whole")).otherwise(0)
    out = ranked.select(
        *keys,
        "product",
        F.col("_sales").cast("double").alias("total_sales"),
        rank.cast("long").alias("product_rank"),
    )
    chosen = slicers.values.get("product")
    return out if chosen is None else out.filter(F.col("product").isin(list(chosen)))


def cumulative_share(
    lines: DataFrame,
    key: str = "customer",
    within: Sequence[str] = (),
    slicers: Slicers = NONE,
    buckets: int = 0,
) -> DataFrame:
    """Revenue per customer with the running total from the largest down.

    Customers with equal revenue share one total.  Columns: keys, ``revenue``,
    ``cumulative`` and ``whole`` as exact sums; callers round and divide.
    """
    keys = list(within)
    per = slicers.apply(lines).groupBy(*keys, key).agg(F.sum("sales").alias("revenue"))
    return concentration(per, keys, buckets)


def concentration(per: DataFrame, keys: Sequence[str] = (), buckets: int = 0) -> DataFrame:
    """Add ``cumulative`` and ``whole`` to rows that hold one ``revenue`` each."""
    return running_totals(
        per, "revenue", {"cumulative": "revenue"}, list(keys), buckets=buckets
    ).withColumnRenamed("cumulative_whole", "whole")
