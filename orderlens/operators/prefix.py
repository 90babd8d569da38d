"""Running totals over a global order without a single-task sort.

A window without PARTITION BY moves every row into one task.  Here rows are dealt
to buckets by ranges of the value, each bucket is summed on its own and shifted by
the total of the buckets before it, which comes from a tree of block sums.  There is
one way for every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.operators.joins import null_safe_join
from orderlens.session import freeze

#: Places that are summed by one window.
BLOCK = 512


def _order(value: str, descending: bool) -> Column:
    return F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()


def _bucketed(peers: DataFrame, value: str, within: list[str], descending: bool, n: int) -> DataFrame:
    """Rows with the number of their range, written once so that every use sees the same ranges."""
    dealt = peers.repartitionByRange(n, *within, _order(value, descending))
    return freeze(dealt.withColumn("_bucket", F.spark_partition_id()))


def sums_before(totals: DataFrame, at: str, sums: list[str], within: list[str], size: int) -> DataFrame:
    """Per group and place the sums over all lower places (``_before_<c>``) and over the group (``_all_<c>``).

    ``totals`` has one row per (``within``, ``at``), places from 0 to ``size`` - 1.  Places
    are summed in blocks of ``BLOCK``, blocks in blocks of blocks, until one is left; every
    window holds one block.  The work is linear in the places, whatever their number.
    """
    rows = totals.select(*within, F.col(at).cast("long").alias("_at"), *[F.col(c).alias(f"_before_{c}") for c in sums])
    parts = [f"_before_{c}" for c in sums]
    inside = Window.partitionBy(*within, "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_block", F.floor(F.col("_at") / BLOCK).cast("long"))
    whole = Window.partitionBy(*within, "_block")
    alone = size <= BLOCK
    found = rows.withColumns(
        {p: F.coalesce(F.sum(p).over(inside), F.lit(0)) for p in parts}
        | ({f"_all_{c}": F.sum(f"_before_{c}").over(whole) for c in sums} if alone else {})
    )
    if not alone:
        blocks = rows.groupBy(*within, "_block").agg(*[F.sum(p).alias(p) for p in parts])
        above = sums_before(blocks, "_block", parts, within, -(-size // BLOCK))
        found = null_safe_join(found, above.withColumnsRenamed({"_at": "_block"}), [*within, "_block"])
        found = found.withColumns(
            {p: F.col(p) + F.col(f"_before_{p}") for p in parts} | {f"_all_{c}": F.col(f"_all__before_{c}") for c in sums}
        )
    return found.select(*within, "_at", *parts, *[f"_all_{c}" for c in sums])


def cumulate_values(
    peers: DataFrame,
    value: str,
    sums: dict[str, str],
    within: list[str] | None = None,
    descending: bool = True,
    inclusive: bool = True,
    buckets: int = 0,
) -> DataFrame:
    """Running totals over rows that are unique in (``within``, ``value``).

    ``sums`` maps each output column to the column it accumulates, with the row
    itself or, unless ``inclusive``, only the rows before it.  The total of the
    whole group comes along as ``<output>_whole``.  Values must not be null.
    ``buckets`` is the number of ranges, by default the shuffle partitions.
    """
    within = list(within or [])
    n = buckets or int(peers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = _bucketed(peers, value, within, descending, n)
    inside = (
        Window.partitionBy(*within, "_bucket")
        .orderBy(_order(value, descending))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = marked.withColumns({out: F.sum(c).over(inside) for out, c in sums.items()})
    totals = marked.groupBy(*within, "_bucket").agg(*[F.sum(c).alias(f"_t_{out}") for out, c in sums.items()])
    offsets = sums_before(totals, "_bucket", [f"_t_{out}" for out in sums], within, n)
    shifted = null_safe_join(local, offsets.withColumnRenamed("_at", "_bucket"), [*within, "_bucket"])
    columns = {}
    for out, c in sums.items():
        own = F.lit(0) if inclusive else F.col(c)
        columns[out] = F.col(out) + F.col(f"_before__t_{out}") - own
        columns[f"{out}_whole"] = F.col(f"_all__t_{out}")
    helpers = [f"_{k}__t_{out}" for out in sums for k in ("before", "all")]
    return shifted.withColumns(columns).drop("_bucket", *helpers)


def running_totals(
    rows: DataFrame,
    value: str,
    sums: dict[str, str],
    within: list[str] | None = None,
    descending: bool = True,
    inclusive: bool = True,
    buckets: int = 0,
) -> DataFrame:
    """Running totals along ``value``; rows with equal values share one total.

    Equivalent to ``SUM(c) OVER (PARTITION BY within ORDER BY value DESC)``
    with its default RANGE frame; unless ``inclusive``, rows of equal value are
    left out of their own total.  ``<output>_whole`` holds the group total.
    Rows with a null value count nowhere and get null totals.

    ``rows`` is written to the shared folder once.  Equal values are folded, the
    folded values are accumulated in buckets, and the totals are joined back.
    """
    within = list(within or [])
    rows = freeze(rows)
    folded = rows.filter(F.col(value).isNotNull()).groupBy(*within, value)
    peers = folded.agg(*[F.sum(c).alias(f"_s_{o}") for o, c in sums.items()])
    totals = cumulate_values(peers, value, {o: f"_s_{o}" for o in sums}, within, descending, inclusive, buckets)
    totals = totals.drop(*[f"_s_{o}" for o in sums])
    return null_safe_join(rows, totals, [*within, value], "left")
