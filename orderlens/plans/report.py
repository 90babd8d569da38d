"""Exploratory report: every headline section as one long table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions import aggregates as A
from orderlens.operators import kpis

DIMENSIONS = ["region", "segment", "industry", "product"]


def _long(df: DataFrame, section: str | Column, key: str | None, metrics: list[str]) -> DataFrame:
    rows = [
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics
    ]
    return df.select(
        (F.lit(section) if isinstance(section, str) else section).alias("section"),
        (F.col(key).cast("string") if key else F.lit("all")).alias("key"),
        F.inline(F.array(*rows)),
    )


def run_eda(lines: DataFrame, n: int = 10) -> DataFrame:
    """(section, key, metric, value): headline figures, loss share and
    correlation, the four breakdowns, top customers, and losses by product.

    Six narrow scans in all: the four breakdowns share two, and the global
    figures of the second section come from a single aggregate.
    """
    headline = kpis.headline_kpis(lines)
    overall = lines.agg(
        F.count_if("is_loss").alias("loss_lines"),
        F.count("*").alias("total_lines"),
        F.round(A.safe_corr("discount", "profit_margin"), 3).alias("corr_discount_margin"),
    ).withColumn("loss_pct", A.pct(F.col("loss_lines"), F.col("total_lines")))
    parts = kpis.breakdowns(lines, DIMENSIONS)
    top = kpis.top_customers(lines, n)
    share = top.agg(F.round(F.sum("pct_of_total"), 1).alias("top_share_pct"))
    losses = kpis.loss_by_product(lines)
    sections = [
        _long(headline, "headline", None, headline.columns),
        _long(
            overall, "lines", None, ["loss_lines", "total_lines", "loss_pct", "corr_discount_margin"]
        ),
        _long(
            parts,
            F.concat(F.lit("by_"), "dimension"),
            "key",
            ["sales", "profit", "avg_discount_pct", "orders", "margin_pct"],
        ),
        _long(top, "top_customers", "customer", ["sales", "pct_of_total"]),
        _long(share, "top_customers", None, ["top_share_pct"]),
        _long(losses, "loss_by_product", "product", ["loss"]),
    ]
    return reduce(DataFrame.unionByName, sections)
