"""Stored sums and bitmaps against the lines themselves."""

import contextlib
import io
from datetime import date

import pytest
from pyspark.sql import functions as F
from test_rules import make

from orderlens.operators import distincts as D
from orderlens.operators import keys, measures
from orderlens.operators.slicers import NONE, Slicers
from orderlens.plans import registry, warehouse

SF = "/root/testdata/sf0.001"
SLICERS = [
    NONE,
    Slicers({"region": ["ASIA", "EUROPE"]}),
    Slicers({"segment": ["SMB"]}, years=[1996, 1998]),
    Slicers({"region": ["nowhere"]}),
]


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("which", range(len(SLICERS)))
@pytest.mark.parametrize("by", [[], ["region"], ["year", "month"], ["industry", "segment"], ["product"], ["customer"]])
def test_the_store_answers_like_the_lines(spark, by, which):
    store, wanted = warehouse.aggregates(spark, SF), list(measures.MEASURES)
    got = store.evaluate(wanted, by, SLICERS[which])
    assert rows(got) == rows(measures.evaluate(warehouse.lines(spark, SF), wanted, by, SLICERS[which]))


def test_the_plan_names_the_aggregate_that_is_read(spark):
    store = warehouse.aggregates(spark, SF)
    sliced = Slicers({"region": ["ASIA"]}, years=[1997])
    seen = plan(store.evaluate(["total_sales", "total_orders"], ["region"], sliced))
    assert "level0_sums" in seen and "level0_bitmaps" in seen and "/lines" not in seen
    assert "level1_sums" in plan(store.evaluate(["total_sales"], ["industry"]))
    assert "level2_sums" in plan(store.evaluate(["total_sales"], ["product"], sliced))
    assert "/lines" in plan(store.evaluate(["total_sales"], ["city"]))
    cut = Slicers(date_range=(date(1997, 1, 5), date(1997, 2, 1)))
    assert store.choose(["region"], cut) is None and "/lines" in plan(store.evaluate(["total_sales"], ["region"], cut))


def test_the_smallest_level_is_chosen(spark):
    store = warehouse.aggregates(spark, SF)
    fit = [v for v in store.levels if v.covers(["segment"], NONE)]
    assert len(fit) == 3 and store.choose(["segment"]).rows == min(v.rows for v in fit)


@pytest.mark.parametrize("name", ["ag2_headline_kpis", "me19_measure_layer"])
def test_two_distinct_counts_copy_no_rows(spark, name):
    lines = warehouse.lines(spark, SF)
    from orderlens.operators import kpis

    df = kpis.headline_kpis(lines) if name.startswith("ag2") else measures.evaluate(lines, list(measures.MEASURES), ["region"])
    assert "Expand" not in plan(df)
    assert name in registry.QUERIES


def test_numbers_over_many_buckets(spark, tmp_path):
    n = 100_000
    df = spark.range(n * 2).select(
        (F.col("id") % n).alias("order_id"), (F.col("id") % 3).alias("cell"), (F.col("id") % 7 == 0).alias("part")
    )
    members = df.select("order_id").distinct()
    numbers = keys.register(members, str(tmp_path / "n"), "number")
    bits = D.bit_rows(df, ["cell", "part"], "order_id", numbers).withColumn("what", F.lit("orders"))
    assert bits.select("bucket").distinct().count() == 4
    want = {r.cell: r.n for r in df.groupBy("cell").agg(F.count_distinct("order_id").alias("n")).collect()}
    assert {r.cell: r._orders for r in D.merged_counts(bits, ["orders"], ["cell"]).collect()} == want
    assert D.merged_counts(bits, ["orders"], []).first()._orders == n


def test_null_ids_null_keys_and_no_lines(spark, tmp_path):
    lines = make(
        spark,
        [dict(order_id=None), dict(customer_id=None, region=None), dict(order_id="O2", region=None), dict(order_id="O2", segment="x")],
    ).withColumns({"year": F.year("order_date"), "month": F.month("order_date")})
    store = D.build_store(lines, str(tmp_path / "a"), [("year", "month", "region", "segment")])
    for by in ([], ["region"], ["segment"]):
        wanted = ["total_sales", "total_orders", "total_customers"]
        assert rows(store.evaluate(wanted, by)) == rows(measures.evaluate(lines, wanted, by))
    none = D.build_store(lines.limit(0), str(tmp_path / "b"), [("year", "region")])
    assert rows(none.evaluate(["total_orders", "total_sales"])) == [(0, None)]
    assert rows(none.evaluate(["total_orders"], ["region"])) == []


def test_months_share_few_buckets(spark, tmp_path):
    """Orders are numbered by their first day, whatever their ids."""
    days = [date(2020, 1 + i % 12, 1 + i % 28) for i in range(600)]
    lines = make(spark, [dict(order_id=f"{(i * 7919) % 1000:04d}", order_date=d) for i, d in enumerate(days)])
    lines = lines.withColumns({"year": F.year("order_date"), "month": F.month("order_date")})
    store = D.build_store(lines, str(tmp_path / "a"), [("year", "month")])
    numbers = keys.read(spark, str(tmp_path / "a" / "numbers" / "orders"), lines.select("order_id").schema, "number")
    first = {r.order_id: r.order_date for r in lines.groupBy("order_id").agg(F.min("order_date").alias("order_date")).collect()}
    ordered = [first[r.order_id] for r in numbers.orderBy("number").collect()]
    assert ordered == sorted(ordered) and store.levels[0].rows == 12
