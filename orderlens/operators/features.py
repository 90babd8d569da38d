"""Derived columns of a cleaned order line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.functions import columns as C
from orderlens.schema import CLEAN_COLUMNS


def engineer_features(df: DataFrame) -> DataFrame:
    """Add date parts, margin, loss flag, discount percent, unit revenue and band.

    One projection of built-in functions; it moves no data.
    """
    out = {
        "year": F.year("order_date"),
        "month": F.month("order_date"),
        "month_name": C.month_name(),
        "quarter": F.quarter("order_date"),
        "year_month": C.year_month(),
        "profit_margin": C.row_margin(),
        "is_loss": C.is_loss(),
        "discount_pct": C.discount_pct(),
        "revenue_per_unit": C.revenue_per_unit(),
        "revenue_band": C.revenue_band(),
    }
    if "date_key" not in df.columns:
        out = {"date_key": C.date_key()} | out
    return df.withColumns(out)


def with_discount_bucket(df: DataFrame) -> DataFrame:
    return df.withColumn("discount_bucket", C.discount_bucket()).withColumn(
        "bucket_order", C.bucket_order()
    )


def clean_layout(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """The 27 contract columns in order, followed by any ``extra`` ones."""
    return df.select(*CLEAN_COLUMNS, *extra)
