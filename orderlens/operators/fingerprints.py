"""Exact duplicates found by row fingerprints: full rows travel only where prints repeat.

Every function reads its input more than once, so the input must give the same rows each time.

Where too many different rows repeat, prints spare nothing: the list of them could not be
broadcast, and all rows would travel to it and then to their equals.  One slice of the prints
tells; rows are then grouped by their columns at once, which finds the same repeats.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.session import freeze

Print = Callable[[Sequence[str]], list[Column]]
PRINT = ["_print_a", "_print_b"]

#: One print in so many tells how many repeat, and up to so many repeated ones rows are found by print.
SLICE, MOST = 64, 500_000


def row_print(columns: Sequence[str]) -> list[Column]:
    """128 bits of a row in two numbers; a null differs from a value and from a null elsewhere."""
    parts = [x for c in columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    return [F.xxhash64(F.lit(salt), *parts) for salt in (1, 2)]


def _printed(df: DataFrame, keys: Sequence[str], prints: Print) -> DataFrame:
    return df.select("*", *[p.alias(n) for p, n in zip(prints(keys), PRINT, strict=True)])


def repeated_prints(df: DataFrame, keys: Sequence[str], prints: Print = row_print) -> DataFrame:
    """Fingerprints that more than one row has, stored: 16 bytes and a count are all that a
    row sends, and equal prints of a task are added up before."""
    found = _printed(df, keys, prints).select(*PRINT).groupBy(*PRINT).agg(F.count("*").alias("n"))
    return freeze(found.filter("n > 1").select(*PRINT))


def many_repeat(df: DataFrame, keys: Sequence[str], prints: Print = row_print) -> bool:
    """Whether over ``MOST`` prints repeat, by those of one slice; it chooses a way, not the result.

    The slice is no filter: under the renamed columns of ``df`` a condition that names all of
    them doubles the planner's constraints with each column.  Prints outside it become null,
    which a task adds up to one row and the count leaves out.
    """
    inside = F.pmod(F.col(PRINT[0]), F.lit(SLICE)) == 0
    slice_ = _printed(df, keys, prints).select(*[F.when(inside, F.col(p)).alias(p) for p in PRINT])
    repeated = slice_.groupBy(*PRINT).agg(F.count(PRINT[0]).alias("n")).where("n > 1")
    return repeated.count() * SLICE > MOST


def suspects(df: DataFrame, keys: Sequence[str], prints: Print = row_print) -> DataFrame:
    """Rows whose fingerprint repeats: all true repeats, and rows that only share a print."""
    return _printed(df, keys, prints).join(repeated_prints(df, keys, prints), PRINT, "left_semi").drop(*PRINT)


def duplicate_count(df: DataFrame, prints: Print = row_print) -> DataFrame:
    """One row, ``n_duplicates``: rows that repeat an earlier one in all columns.

    Suspects are compared in full, so a shared fingerprint never counts as a repeat.  They are
    grouped by their columns, not by their print: copies of one row are added up before they
    are sent.  An empty table, and one without columns, has the count its rows give.
    """
    if not df.columns:
        return df.agg(F.greatest(F.count("*") - 1, F.lit(0)).alias("n_duplicates"))
    rows = df if many_repeat(df, df.columns, prints) else suspects(df, df.columns, prints)
    same = rows.groupBy(*[F.col(f"`{c}`") for c in df.columns])
    beyond = same.agg(F.count("*").alias("_copies")).agg(F.sum(F.col("_copies") - 1).alias("n"))
    return beyond.select(F.coalesce("n", F.lit(0)).cast("long").alias("n_duplicates"))


def distinct_rows(
    df: DataFrame, ignore: Sequence[str] = (), prints: Print = row_print
) -> DataFrame:
    """Rows without exact repeats; of equal rows the one with the least ``ignore`` values stays.

    Rows of a lone fingerprint pass without a shuffle.
    """
    skip = [c for c in df.columns if c in set(ignore)]
    keys = [c for c in df.columns if c not in skip]
    if not keys:
        return df.dropDuplicates()
    order = [F.col(f"`{c}`") for c in df.columns]
    if many_repeat(df, keys, prints):
        return _least(df, keys, skip).select(*order)
    printed = _printed(df, keys, prints)
    again = repeated_prints(df, keys, prints)
    lone = printed.join(again, PRINT, "left_anti").drop(*PRINT)
    several = _least(printed.join(again, PRINT, "left_semi").drop(*PRINT), keys, skip)
    return lone.select(*order).unionByName(several.select(*order))


def _least(rows: DataFrame, keys: Sequence[str], skip: Sequence[str]) -> DataFrame:
    """One row per ``keys``, with the least values of ``skip``."""
    if not skip:
        return rows.dropDuplicates()
    least = F.min(F.struct(*[F.col(f"`{c}`") for c in skip])).alias("_kept")
    return rows.groupBy(*[F.col(f"`{c}`") for c in keys]).agg(least).select(*[F.col(f"`{c}`") for c in keys], "_kept.*")
