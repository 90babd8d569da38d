"""Exact quantiles of many columns without sorting a whole column in one task.

Pass 1 sketches each column and yields, per quantile, a narrow interval that is
sure to hold it.  Pass 2 counts what lies between the intervals and keeps single
values only inside them.  The wanted ranks are then read from running counts.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.operators.prefix import cumulate_values
from orderlens.session import freeze


def _merge(intervals: list[tuple[float, float]]) -> list[tuple[float, float]]:
    merged: list[tuple[float, float]] = []
    for low, high in sorted(intervals):
        if merged and low <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    return merged


def _number(x: float) -> str:
    return f"double('{x!r}')"


def _cell(i: int, intervals: list[tuple[float, float]]) -> str:
    """SQL struct (i, is_gap, v) for column ``x{i}``.

    A value inside an interval stands for itself.  A gap is represented by the
    upper end of the interval before it (or -infinity), which sorts before
    everything in the next interval.
    """
    x = f"x{i}"
    inside = " OR ".join(f"{x} BETWEEN {_number(lo)} AND {_number(hi)}" for lo, hi in intervals)
    gaps = " ".join(f"WHEN {x} > {_number(hi)} THEN {_number(hi)}" for _, hi in reversed(intervals))
    return (
        f"struct({i} AS i, NOT ({inside}) AS is_gap, "
        f"CASE WHEN {inside} THEN {x} {gaps} ELSE {_number(float('-inf'))} END AS v, "
        f"{x} IS NOT NULL AS present)"
    )


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probabilities: list[float],
    accuracy: int = 10_000,
    buckets: int = 0,
) -> DataFrame:
    """(column, probability, quantile) with linear interpolation between ranks.

    Nulls and NaN are skipped.  A column without values gives null quantiles.
    """
    spark = df.sparkSession
    # Converted once, here: the expressions below mention each value many times.
    missing = F.lit(None).cast("double")
    df = df.select(
        *[F.nanvl(F.col(f"`{c}`").cast("double"), missing).alias(f"x{i}") for i, c in enumerate(columns)]
    )
    counts = df.agg(*[F.count(f"x{i}") for i in range(len(columns))]).first()

    def marks(n: int) -> list[float]:
        slack = 3.0 / accuracy + 2.0 / max(n, 1)  # sketch error on both sides, and ranks of interpolation
        return [min(1.0, max(0.0, p + d)) for p in probabilities for d in (-slack, slack)]

    sketch = df.agg(
        *[F.percentile_approx(f"x{i}", marks(counts[i]), accuracy) for i in range(len(columns))]
    ).first()
    wanted, intervals = [], {}
    for i in range(len(columns)):
        n, cuts = counts[i], sketch[i]
        if n:
            intervals[i] = _merge([(cuts[2 * j], cuts[2 * j + 1]) for j in range(len(probabilities))])
        for j, p in enumerate(probabilities):
            at = p * (n - 1) if n else -1.0
            lo = math.floor(at)
            wanted.append(f"({i}, {j}, {lo}L, {math.ceil(at)}L, {_number(at - lo)})")
    targets = spark.sql(f"SELECT * FROM VALUES {', '.join(wanted)} AS t(i, j, lo, hi, frac)")

    structs = ", ".join(_cell(i, intervals[i]) for i in intervals)
    cells = df.selectExpr(f"inline(array({structs}))") if intervals else spark.sql(
        "SELECT 0 AS i, true AS is_gap, double(0) AS v, false AS present"
    )
    # The gaps collapse to one row each, so little beyond the intervals is shuffled.
    # A gap and the value it borrows share v; they fold, the gap after the value.
    per_value = freeze(
        cells.filter("present")
        .groupBy("i", "v")
        .agg(F.count_if(~F.col("is_gap")).alias("n_value"), F.count("*").alias("n_all"))
    )
    cum = cumulate_values(
        per_value, "v", {"upto": "n_all"}, ["i"], descending=False, buckets=buckets
    )
    ranked = cum.selectExpr("i", "v", "upto - n_all AS first_rank", "upto - n_all + n_value AS last_rank")
    covers = "first_rank <= {0} AND {0} < last_rank"
    picked = (
        ranked.join(F.broadcast(targets), "i")
        .groupBy("i", "j")
        .agg(
            F.expr(f"max(CASE WHEN {covers.format('lo')} THEN v END)").alias("a"),
            F.expr(f"max(CASE WHEN {covers.format('hi')} THEN v END)").alias("b"),
        )
    )
    # One row per column and probability on both sides.
    picked = targets.join(F.broadcast(picked), ["i", "j"], "left")
    names = F.array(*[F.lit(c) for c in columns])
    levels = F.array(*[F.lit(p) for p in probabilities])
    return picked.select(
        names[F.col("i")].alias("column"),
        levels[F.col("j")].alias("probability"),
        F.expr("a + (b - a) * frac").alias("quantile"),
    )
