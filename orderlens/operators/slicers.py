"""Filter context shared by the visuals of a page."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Slicers:
    """Filter context shared by the visuals of a page."""

    values: Mapping[str, Sequence] = field(default_factory=dict)
    years: Sequence[int] | None = None
    date_range: tuple[date, date] | None = None

    def without_dates(self) -> Slicers:
        return Slicers(self.values)

    def without(self, column: str) -> Slicers:
        kept = {k: v for k, v in self.values.items() if k != column}
        return Slicers(kept, self.years, self.date_range)

    def apply(self, df: DataFrame, date_column: str = "order_date") -> DataFrame:
        for column, allowed in self.values.items():
            df = df.filter(F.col(column).isin(list(allowed)))
        if self.years is not None:
            df = df.filter(F.col("year").isin(list(self.years)))
        if self.date_range is not None:
            lo, hi = self.date_range
            df = df.filter(F.col(date_column).between(lo, hi))
            if "year" in df.columns:  # prunes the year partitions
                df = df.filter(F.col("year").between(lo.year, hi.year))
        return df


NONE = Slicers()
