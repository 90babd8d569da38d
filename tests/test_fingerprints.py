"""Duplicates by fingerprint against plain comparison of whole rows."""

import random

import pytest
from pyspark.sql import functions as F

from orderlens.operators import clean, profile
from orderlens.operators import fingerprints as P


def some_rows(spark, n=400, seed=5):
    pick = random.Random(seed)
    rows = [
        (pick.choice([None, "a", "b", ""]), pick.choice([None, 0.0, -0.0, float("nan"), 1.5]), pick.choice([None, 1, 2]))
        for _ in range(n)
    ]
    return spark.createDataFrame(rows, "`a b` string, x double, n int")


def one_print(columns):
    """Every row has the same fingerprint."""
    return [F.lit(1).cast("long"), F.lit(2).cast("long")]


def few_prints(columns):
    return [F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in columns]), F.lit(3)), F.lit(0).cast("long")]


def bag(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("prints", [P.row_print, one_print, few_prints])
def test_counts_and_rows_hold_under_any_prints(spark, prints):
    df = some_rows(spark)
    plain = df.dropDuplicates()
    assert P.duplicate_count(df, prints).first().n_duplicates == df.count() - plain.count()
    assert bag(P.distinct_rows(df, prints=prints)) == bag(plain)
    kept = P.distinct_rows(df, ["n"], prints)
    least = df.groupBy("`a b`", "x").agg(F.min(F.struct("n")).alias("k")).select("`a b`", "x", "k.*")
    assert bag(kept) == bag(least) and kept.columns == df.columns


def test_nulls_in_other_places_differ(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), (None, None), (None, None)], "x string, y string")
    prints = df.select(*P.row_print(df.columns)).distinct().count()
    assert prints == 3 and profile.duplicate_rows(df).first().n_duplicates == 1
    assert clean.drop_duplicates(df).count() == 3


def test_empty_and_one_hot_row(spark):
    df = spark.range(0).selectExpr("id", "'x' AS t")
    assert profile.duplicate_rows(df).first().n_duplicates == 0 and clean.drop_duplicates(df).count() == 0
    hot = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN -1L ELSE id END AS k", "'t' AS t")
    assert profile.duplicate_rows(hot).first().n_duplicates == 9_999
    assert clean.drop_duplicates(hot).count() == 20_001


def test_little_is_shuffled_without_repeats(spark):
    """Rows go to the exchange as two numbers, not with their columns."""
    df = spark.range(1000).selectExpr("id", "repeat(cast(id AS string), 50) AS wide")
    plan = P._printed(df, df.columns, P.row_print).select(*P.PRINT).groupBy(*P.PRINT).count()
    text = plan._jdf.queryExecution().executedPlan().toString()
    exchange = next(x for x in text.splitlines() if "Exchange" in x)
    assert "_print_a" in exchange and "wide" not in exchange


def test_the_slice_is_no_condition_over_all_columns(spark, tmp_path, monkeypatch):
    """Below renamed columns such a condition makes the planner's constraints double with every one of them."""
    names = [f"c{i}" for i in range(9)]
    (tmp_path / "f.csv").write_text("\n".join(",".join(x) for x in (names, ["1"] * 9, ["1"] * 9, ["2"] * 9)))
    raw = spark.read.option("header", True).csv(str(tmp_path / "f.csv"))
    df = raw.select(*[F.when(F.col(c) != "", F.col(c)).alias(f"n{c}") for c in names])
    asked = []
    with monkeypatch.context() as m:
        m.setattr(type(df), "count", lambda self: asked.append(self) or 0)
        assert not P.many_repeat(df, df.columns)
    plan = asked[0]._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [x for x in plan if "Filter" in x and all(c in x for c in names)]
    monkeypatch.setattr(P, "SLICE", 1)
    monkeypatch.setattr(P, "MOST", 0)
    assert P.many_repeat(df, df.columns) and not P.many_repeat(df.distinct(), df.columns)
