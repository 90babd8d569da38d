"""Contiguous calendar over whole years."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.operators.joins import null_safe_join


def date_table(dates: DataFrame, column: str = "full_date") -> DataFrame:
    """All days from 1 January of the first year to 31 December of the last.

    ``dates`` may be any frame with a date column; a date dimension is enough.
    """
    bounds = dates.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    days = bounds.select(
        F.explode(
            F.sequence(
                F.trunc("lo", "year"),
                F.make_date(F.year("hi"), F.lit(12), F.lit(31)),
                F.expr("interval 1 day"),
            )
        ).alias("date")
    )
    return days.select(
        "date",
        F.year("date").alias("year"),
        F.month("date").alias("month"),
        F.date_format("date", "MMM").alias("month_name"),
        F.date_format("date", "MMM yyyy").alias("month_year"),
        F.concat(F.lit("Q"), F.quarter("date").cast("string")).alias("quarter"),
        (F.year("date") * 100 + F.month("date")).alias("year_month_sort"),
    )


def month_labels(calendar: DataFrame) -> DataFrame:
    """Month names and month-year labels with the columns that sort them."""
    return (
        calendar.groupBy("month_year", "year_month_sort", "month_name", "month")
        .agg(F.count("*").alias("n_days"))
        .orderBy("year_month_sort")
    )


def daily_sales(lines: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every calendar day with its sales; days without sales stay, with null."""
    sold = lines.groupBy(F.col("order_date").alias("date")).agg(
        F.sum("sales").cast("double").alias("sales"), F.count("*").alias("n_lines")
    )
    joined = null_safe_join(calendar, sold, ["date"], "left")
    return joined.select(
        "date", "year", "month", "sales", F.coalesce("n_lines", F.lit(0)).alias("n_lines")
    ).orderBy("date")
