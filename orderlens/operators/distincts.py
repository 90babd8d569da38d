"""Exact distinct counts that can be stored, merged and sliced.

A distinct count cannot be added up, but a set of gapless numbers can be kept as bitmaps:
a number's bucket and its place in the bucket.  Bitmaps of any cells are merged with OR and
counted by their bits, so counts stored per cell answer every grouping and slicer over the
cells' keys exactly, without the lines.

An aggregate store is a small lattice of levels.  Each level holds, for its keys, the sums
that the plain measures are made of and the bitmaps of their distinct counts.  A request is
answered by the smallest level that has its keys and slicers, else by the lines.

Orders are numbered in the order of their first day, so a month's orders share few buckets.
Numbers come from a lasting registry; a null id counts nowhere, null keys are a cell like
any other.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.operators import keys as registry
from orderlens.operators import measures as M
from orderlens.operators.joins import null_safe_join
from orderlens.operators.slicers import NONE, Slicers
from orderlens.session import freeze
from orderlens.sources.tables import write_table

@dataclass(frozen=True)
class Level:
    keys: tuple[str, ...]
    sums: DataFrame
    bitmaps: DataFrame
    rows: int

    def covers(self, by: Sequence[str], slicers: Slicers) -> bool:
        """A date range may cut a cell, so only values and years can be answered."""
        asked = {*by, *slicers.values, *(["year"] if slicers.years is not None else [])}
        return slicers.date_range is None and asked <= set(self.keys)


@dataclass(frozen=True)
class Store:
    lines: DataFrame
    levels: list[Level]

    def choose(self, by: Sequence[str] = (), slicers: Slicers = NONE) -> Level | None:
        """The smallest level that holds all keys and slicers; None where only the lines do."""
        fit = [v for v in self.levels if v.covers(by, slicers)]
        return min(fit, key=lambda v: v.rows) if fit else None

    def evaluate(
        self, measures: Sequence[str], by: Sequence[str] = (), slicers: Slicers = NONE, share_of_total: bool = False
    ) -> DataFrame:
        """What ``measures.evaluate`` returns over the lines, from the smallest level that can tell."""
        level = self.choose(by, slicers)
        if level is None:
            return M.evaluate(self.lines, measures, by, slicers, share_of_total)
        needed = M.bases_of(measures, share_of_total)
        found = bases(level, needed, by, slicers)
        return M.finish(found, measures, by, share_of_total)


def bit_rows(lines: DataFrame, cells: Sequence[str], column: str, numbers: DataFrame) -> DataFrame:
    """(cells, bucket, bitmap) of the numbers that ``column`` has in each cell.

    ``numbers`` holds ``column`` and its ``number``; pairs are made distinct before the join.
    They are sent to their cell's bucket as numbers: a bitmap has 4 KB however few bits are
    set, so none is made before all of its numbers, at most 32,768, are in one task.
    """
    pairs = lines.where(F.col(column).isNotNull()).select(*cells, column).distinct()
    found = pairs.join(numbers, column)
    places = found.select(
        *cells, F.bitmap_bucket_number("number").alias("bucket"), F.bitmap_bit_position("number").alias("_place")
    )
    dealt = places.repartition(*cells, "bucket")
    return dealt.groupBy(*cells, "bucket").agg(F.bitmap_construct_agg("_place").alias("bitmap"))


def merged_counts(bitmaps: DataFrame, whats: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Distinct counts ``_<what>`` by any keys of the cells: OR inside a bucket, then bits added up."""
    merged = bitmaps.where(F.col("what").isin(list(whats))).groupBy(*by, "what", "bucket").agg(
        F.bitmap_or_agg("bitmap").alias("bitmap")
    )
    bits = F.bitmap_count("bitmap")
    return merged.groupBy(*by).agg(
        *[F.coalesce(F.sum(F.when(F.col("what") == w, bits)), F.lit(0)).alias(f"_{w}") for w in whats]
    )


def bases(level: Level, needed: set[str], by: Sequence[str], slicers: Slicers) -> DataFrame:
    """The bases of measures by any keys of a level, as ``measures.evaluate`` takes them from lines."""
    sums = sorted(needed - set(M.COUNTED))
    sliced = slicers.apply(level.sums)
    added = [F.sum(s).alias(f"_{s}") for s in sums] or [F.count("*").alias("_cells")]
    found = sliced.groupBy(*by).agg(*added)
    whats = sorted(needed & set(M.COUNTED))
    if not whats:
        return found
    counts = merged_counts(slicers.apply(level.bitmaps), whats, by)
    if by:
        found = null_safe_join(found, counts, list(by), "left")
    else:
        found = found.select("*", *[counts.select(f"_{w}").scalar().alias(f"_{w}") for w in whats])
    return found.withColumns({f"_{w}": F.coalesce(f"_{w}", F.lit(0)) for w in whats})


def build_store(lines: DataFrame, root: str, levels: Sequence[Sequence[str]]) -> Store:
    """Number orders and customers, and write sums and bitmaps of every level under ``root``."""
    numbers = {}
    for what, column in M.COUNTED.items():
        members = lines.where(F.col(column).isNotNull()).groupBy(column).agg(F.min("order_date").alias("_first"))
        order = ["_first"] if what == "orders" else []
        # dealing to ranges reads its input twice
        members = freeze(members.select(column, *order))
        numbers[what] = registry.register(members, f"{root}/numbers/{what}", "number", order)
    built = []
    for n, cells in enumerate(levels):
        added = M.bases()
        sums = lines.groupBy(*cells).agg(*[c.alias(b) for b, c in added.items()])
        stored = write_table(sums, f"{root}/level{n}_sums")
        parts = [
            bit_rows(lines, cells, column, numbers[what]).withColumn("what", F.lit(what)) for what, column in M.COUNTED.items()
        ]
        bits = write_table(parts[0].unionByName(parts[1]), f"{root}/level{n}_bitmaps")
        built.append(Level(tuple(cells), stored, bits, stored.count()))
    return Store(lines, built)
