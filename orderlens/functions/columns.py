"""Row-level expressions: date parts, margins, bands and buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Band and bucket edges (right-closed) with their labels.
REVENUE_BANDS = [(250, "<250"), (1000, "250-1K"), (5000, "1K-5K")]
REVENUE_TOP = "5K+"
DISCOUNT_BUCKETS = [(0.10, "1-10%"), (0.20, "11-20%"), (0.30, "21-30%")]
DISCOUNT_ZERO = "0%"
DISCOUNT_TOP = "30%+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _dbl(c: Column | str) -> Column:
    return _col(c).cast("double")


def date_key(d: Column | str = "order_date") -> Column:
    return F.date_format(_col(d), "yyyyMMdd").cast("int")


def month_name(d: Column | str = "order_date") -> Column:
    return F.date_format(_col(d), "MMM")


def year_month(d: Column | str = "order_date") -> Column:
    return F.date_format(_col(d), "yyyy-MM")


def row_margin(profit: Column | str = "profit", sales: Column | str = "sales") -> Column:
    """profit / sales of one line, null where sales is zero."""
    return F.try_divide(_dbl(profit), _dbl(sales))


def row_margin_pct(profit: Column | str = "profit", sales: Column | str = "sales") -> Column:
    return F.round(F.try_divide(_dbl(profit) * 100, _dbl(sales)), 2)


def is_loss(profit: Column | str = "profit") -> Column:
    """Loss flag; a missing profit is not a loss."""
    return F.coalesce(_col(profit) < 0, F.lit(False))


def discount_pct(discount: Column | str = "discount") -> Column:
    return F.round(_dbl(discount) * 100, 1)


def revenue_per_unit(sales: Column | str = "sales", quantity: Column | str = "quantity") -> Column:
    """Realised revenue per unit, null unless the quantity is positive."""
    return F.when(_col(quantity) > 0, _dbl(sales) / _dbl(quantity))


def revenue_band(sales: Column | str = "sales") -> Column:
    """Right-closed band of a line's revenue; null stays null."""
    s = _col(sales)
    out = F.when(s.isNull(), F.lit(None).cast("string"))
    for edge, label in REVENUE_BANDS:
        out = out.when(s <= edge, label)
    return out.otherwise(REVENUE_TOP)


def revenue_band_order(band: Column | str = "revenue_band") -> Column:
    b = _col(band)
    labels = [label for _, label in REVENUE_BANDS] + [REVENUE_TOP]
    out = F.when(b == labels[0], 1)
    for i, label in enumerate(labels[1:], start=2):
        out = out.when(b == label, i)
    return out


def discount_bucket(discount: Column | str = "discount") -> Column:
    """Discount band; null lands in the open top band, as a searched CASE does."""
    d = _dbl(discount)
    out = F.when(d == 0, DISCOUNT_ZERO)
    for edge, label in DISCOUNT_BUCKETS:
        out = out.when(d <= edge, label)
    return out.otherwise(DISCOUNT_TOP)


def discount_bucket_cut(discount: Column | str = "discount") -> Column:
    """Interval form of the bucket: (-0.01, 0], (0, 0.10], ... (0.30, 1]; else null."""
    d = _dbl(discount)
    out = F.when((d <= -0.01) | (d > 1) | d.isNull(), F.lit(None).cast("string"))
    out = out.when(d <= 0, DISCOUNT_ZERO)
    for edge, label in DISCOUNT_BUCKETS:
        out = out.when(d <= edge, label)
    return out.otherwise(DISCOUNT_TOP)


def bucket_order(bucket: Column | str = "discount_bucket") -> Column:
    b = _col(bucket)
    out = F.when(b == DISCOUNT_ZERO, 0)
    for i, (_, label) in enumerate(DISCOUNT_BUCKETS, start=1):
        out = out.when(b == label, i)
    return out.when(b == DISCOUNT_TOP, len(DISCOUNT_BUCKETS) + 1)


def health_status(profit: Column, sales: Column) -> Column:
    """Profitability label from summed profit and sales."""
    return (
        F.when(profit < 0, "LOSS-MAKING")
        .when(F.try_divide(profit.cast("double"), sales.cast("double")) < 0.10, "THIN MARGIN")
        .otherwise("HEALTHY")
    )
