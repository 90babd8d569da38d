"""Aggregates over several distinct counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.operators.joins import null_safe_join


def grouped(df: DataFrame, sums: dict[str, Column], distinct: dict[str, str], by: Sequence[str]) -> DataFrame:
    """Sums and several distinct counts by ``by``, each count from its own narrow aggregate.

    One aggregate with several distinct counts copies every row once per count before
    anything is folded; here no row is copied.
    """
    first, *others = list(distinct.items()) or [None]
    lead = [] if first is None else [F.count_distinct(first[1]).alias(first[0])]
    found = df.groupBy(*by).agg(*[c.alias(n) for n, c in sums.items()], *lead)
    for name, column in others:
        own = df.groupBy(*by).agg(F.count_distinct(column).alias(name))
        found = null_safe_join(found, own, list(by)) if by else found.select("*", own.scalar().alias(name))
    return found
