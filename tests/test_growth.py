"""Work and memory that follow the rows: plans, and the same results by either way."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_distincts import rows

from orderlens.operators import distincts as D
from orderlens.operators import fingerprints as P
from orderlens.operators import star
from orderlens.plans import registry, warehouse
from orderlens.session import ROWS_A_TASK, spread
from orderlens.sources import rejects, tpch

SMALL = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_spread_follows_the_rows_and_gives_settings_back(spark):
    names = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    before = [spark.conf.get(n, None) for n in names]
    try:
        with spread(spark, 100 * ROWS_A_TASK + 1):
            assert spark.conf.get(names[0]) == "101" and spark.conf.get(names[1]) == "16m"
            raise KeyError
    except KeyError:
        pass
    assert [spark.conf.get(n, None) for n in names] == before
    with spread(spark, 0):
        assert spark.conf.get(names[0]) == before[0]


def test_texts_made_of_others_do_not_meet_the_large_join(spark):
    plan = optimized(tpch.order_lines(spark, "/root/testdata/sf0.001"))
    assert plan.index("Contact of ") < plan.index("Join")


def test_no_bitmap_is_shuffled_while_it_is_made(spark):
    numbers = spark.range(50).selectExpr("id AS order_id", "id + 1 AS number")
    lines = spark.range(200).selectExpr("id % 50 AS order_id", "id % 3 AS cell")
    plan = physical(D.bit_rows(lines, ["cell"], "order_id", numbers))
    made = [n for n, x in enumerate(plan) if "bitmap_construct_agg" in x]
    assert made and not any("Exchange" in x for x in plan[made[0] : made[-1]])


def test_rows_of_many_repeats_are_grouped_at_once(spark, monkeypatch):
    df = spark.range(3000).select((F.col("id") % 900).alias("k"), F.when(F.col("id") % 7 > 0, "t").alias("t"), F.col("id").alias("own"))
    for ignore in ([], ["own"]):
        one = df if ignore else df.drop("own")
        few, n_few = rows(P.distinct_rows(one, ignore)), P.duplicate_count(one.drop("own")).first()
        monkeypatch.setattr(P, "MOST", 10)
        assert P.many_repeat(one, [c for c in one.columns if c not in ignore])
        plan = "\n".join(physical(P.distinct_rows(one, ignore)))
        assert "Join" not in plan
        assert rows(P.distinct_rows(one, ignore)) == few and P.duplicate_count(one.drop("own")).first() == n_few
        monkeypatch.undo()


def test_lone_rows_are_still_found_by_print(spark):
    assert not P.many_repeat(spark.range(1000).toDF("a"), ["a"])


def test_customers_are_joined_last(spark):
    lines = spark.createDataFrame(
        [(1, 20200101, 7, "P", "c", "t", "r", "s", 1.0, 1, 0.1, 0.2)],
        "order_id int, date_key int, customer_id int, product string, country string, city string, region string,"
        " subregion string, sales double, quantity int, discount double, profit double",
    )
    customers = spark.createDataFrame([(1, 7)], "customer_key long, customer_id int")
    products = spark.createDataFrame([(2, "P")], "product_key long, product_name string")
    places = spark.createDataFrame([(3, "c", "t", "r", "s")], "geography_key long, country string, city string, region string, subregion string")
    fact = star.fact_sales(lines, customers, products, places)
    first = next(x for x in optimized(fact).splitlines() if "Join" in x)
    assert "_cid" in first
    assert [(r.customer_key, r.product_key, r.geography_key) for r in fact.collect()] == [(1, 2, 3)]


def test_a_value_is_converted_once(spark):
    lines = spark.range(4).selectExpr("'f' AS file", "concat(if(id = 3, 'x', string(id)), ',\"b,b\"') AS line", "false AS other_header")
    tagged = rejects.tag_lines(lines, "n,t", T.StructType([T.StructField("n", T.IntegerType())]))
    assert optimized(tagged).count("try_cast") == 1
    assert sorted((str(r.reason), r.v.n, r.v.t) for r in tagged.collect() if r.v.n is not None) == [
        ("None", i, "b,b") for i in range(3)
    ]
    assert [r.reason for r in tagged.collect() if r.v.n is None] == ["bad value: n"]


def copied(monkeypatch, tmp_path, rows_a_slice):
    """The smallest tables under a path of their own, so nothing is stored for them yet."""
    monkeypatch.setattr(warehouse, "ROWS_A_SLICE", rows_a_slice)
    (tmp_path / "tables").symlink_to(SMALL)
    return str(tmp_path / "tables")


def lines_of(df):
    return sorted(str(tuple(sorted(r.asDict().items()))) for r in df.collect())


@pytest.mark.parametrize("query, folder", [("io4_bi_load", "csv_bi"), ("io3_staging_load", "csv_staging")])
def test_the_clean_csv_is_packed_and_joined_in_slices(spark, monkeypatch, tmp_path, query, folder):
    """Neither plain text, nor stored lines beside it, nor the shuffle files of all lines at once."""
    d, keys = copied(monkeypatch, tmp_path, 1000), [*warehouse.SPARING, "spark.sql.shuffle.partitions"]
    before, asked = [spark.conf.get(k, None) for k in keys], []
    with monkeypatch.context() as m:
        m.setattr(tpch, "clean_lines", lambda s, p, *one, whole=tpch.clean_lines: asked.append(one) or whole(s, p, *one))
        got = registry.QUERIES[query](spark, d)
    assert len(asked) == 6 and [spark.conf.get(k, None) for k in keys] == before
    path = warehouse.folder(spark, d, folder)
    stored = [f for f in os.listdir(path.removeprefix("file:")) if f.startswith("part-")]
    assert stored and all(f.endswith(".csv.gz") for f in stored)
    assert not os.path.exists(warehouse.folder(spark, d, "lines").removeprefix("file:"))
    found = lines_of(got)
    warehouse.lines(spark, d)
    assert lines_of(registry.QUERIES[query](spark, d)) == found


def test_slices_hold_every_line_once(spark, monkeypatch, tmp_path):
    d = copied(monkeypatch, tmp_path, 1000)
    parts = [tpch.clean_lines(spark, d, i, 6) for i in range(6)]
    assert all(not p.isEmpty() for p in parts)
    whole = lines_of(tpch.clean_lines(spark, d))
    assert sorted(x for p in parts for x in lines_of(p)) == whole == lines_of(warehouse.lines(spark, d))
