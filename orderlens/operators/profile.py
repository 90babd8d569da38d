"""Structural profile of a table: shape, types, missing values, repeats, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.operators.fingerprints import duplicate_count
from orderlens.operators.quantiles import exact_quantiles

SUMMARY = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def column_types(df: DataFrame) -> DataFrame:
    rows = [(i, name, kind) for i, (name, kind) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string")


def missing_values(df: DataFrame) -> DataFrame:
    """(column, n_missing) in one pass; NaN counts as missing."""
    checks = []
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        gone = c.isNull()
        if isinstance(field.dataType, T.FloatType | T.DoubleType):
            gone = gone | F.isnan(c)
        checks.append(F.count_if(gone).alias(field.name))
    return df.agg(*checks).unpivot([], [f"`{c}`" for c in df.columns], "column", "n_missing")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Number of rows that repeat an earlier one in all columns.

    Fingerprints are counted first; only rows whose print repeats are compared in full.
    """
    return duplicate_count(df)


def inspect_data(df: DataFrame) -> dict[str, DataFrame]:
    """The whole profile; each part is a lazy frame and changes nothing."""
    return {
        "shape": shape(df),
        "types": column_types(df),
        "missing": missing_values(df),
        "duplicates": duplicate_rows(df),
        "summary": numeric_summary(df),
    }


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def numeric_summary(df: DataFrame, approximate: bool = False, digits: int = 2) -> DataFrame:
    """count, mean, sample deviation, min, quartiles and max of each numeric column.

    Quartiles are exact and interpolated; ``approximate`` takes them from the
    sketch alone and saves the second pass.
    """
    names = numeric_columns(df)
    missing = F.lit(None).cast("double")
    df = df.select(*[F.nanvl(F.col(f"`{c}`").cast("double"), missing).alias(c) for c in names])
    parts = []
    for i, x in enumerate(F.col(f"`{c}`") for c in names):
        fields = [
            F.count(x).cast("double").alias("count"),
            F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("std"),
            F.min(x).alias("min"),
            F.max(x).alias("max"),
        ]
        if approximate:
            marks = F.percentile_approx(x, [0.25, 0.5, 0.75], 10_000)
            fields += [F.get(marks, j).alias(p) for j, p in enumerate(("p25", "p50", "p75"))]
        parts.append(F.struct(*fields).alias(f"c{i}"))
    moments = df.agg(*parts).select(
        F.explode(
            F.array(
                *[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("s")) for i, c in enumerate(names)]
            )
        ).alias("e")
    )
    wide = moments.select("e.column", "e.s.*")
    if not approximate:
        quartiles = exact_quantiles(df, names, [0.25, 0.5, 0.75])
        spread = quartiles.groupBy("column").agg(
            *[
                F.max(F.when(F.col("probability") == p, F.col("quantile"))).alias(name)
                for p, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))
            ]
        )
        # One row per numeric column on both sides.
        wide = wide.join(F.broadcast(spread), "column", "left")
    return wide.select("column", *[F.round(F.col(s), digits).alias(s) for s in SUMMARY])
