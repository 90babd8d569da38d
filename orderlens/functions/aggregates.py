"""Aggregate expressions shared by all reports.

Money is summed as exact decimals and turned into a double only afterwards, so
a total does not depend on the order in which partitions arrive.  Margins are
always ratios of sums.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderlens.functions.columns import _col, _dbl


def total(c: Column | str) -> Column:
    return F.sum(_col(c)).cast("double")


def total_or_zero(c: Column | str) -> Column:
    """Sum in which an all-missing group counts as zero."""
    return F.coalesce(total(c), F.lit(0.0))


def mean(c: Column | str) -> Column:
    """Average as exact sum over count of present values."""
    return F.try_divide(total(c), F.count(_col(c)).cast("double"))


def mean_of_pct(c: Column | str) -> Column:
    """Average of a percentage column held with one decimal place."""
    return mean(_col(c).cast("decimal(12,1)"))


def ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))


def pct(num: Column, den: Column, digits: int | None = 1) -> Column:
    """100 * num / den; null on a zero denominator."""
    value = F.try_divide(num.cast("double") * 100, den.cast("double"))
    return value if digits is None else F.round(value, digits)


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation over rows where both are present; null on a constant."""
    x, y = _dbl(x), _dbl(y)
    xs, ys = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(xs) * F.stddev_pop(ys))


def corr_matrix_exprs(columns: list[str]) -> list[Column]:
    """One aggregate per unordered pair; a diagonal cell is 1 unless the column is constant."""
    pairs = [safe_corr(a, b).alias(f"{a}|{b}") for a, b in combinations(columns, 2)]
    return pairs + [F.when(F.min(a) < F.max(a), 1.0).alias(f"{a}|{a}") for a in columns]
