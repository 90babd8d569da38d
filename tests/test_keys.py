"""The key registry over several loads."""

import contextlib
import io
from datetime import date

import pytest
from pyspark.sql import functions as F
from test_rules import make

from orderlens.operators import keys as K
from orderlens.operators import star as S


def members(spark, names):
    return spark.createDataFrame([(n,) for n in names], "name string")


def held(df):
    return {r.name: r.k for r in df.collect()}


def test_numbers_follow_the_natural_key_however_rows_are_dealt(spark):
    df = spark.range(3000).select(F.format_string("c%05d", "id").alias("name"))
    want = {f"c{i:05d}": i + 1 for i in range(3000)}
    for buckets in (1, 3, 50, None):
        assert held(K.number_rows(df.repartition(7).orderBy(F.rand(2)), ["name"], "k", buckets)) == want


def test_numbers_pass_32_bits(spark):
    df = members(spark, "abc")
    assert held(K.number_rows(df, ["name"], "k", after=2**31 - 2)) == {"a": 2**31 - 1, "b": 2**31, "c": 2**31 + 1}


def test_a_second_load_keeps_all_old_numbers(spark, tmp_path):
    path = str(tmp_path / "r")
    first = [f"m{i}" for i in range(1000)]
    one = held(K.register(members(spark, first), path, "k"))
    assert sorted(one.values()) == list(range(1, 1001))
    second = [f"m{i}" for i in range(500, 1100)] + [None]
    two = held(K.register(members(spark, second), path, "k"))
    assert {n: k for n, k in two.items() if n in one} == one
    assert sorted(k for n, k in two.items() if n not in one) == list(range(1001, 1102))
    three = held(K.register(members(spark, [None, "m3"]), path, "k"))
    assert three == two
    assert sorted(p.name for p in (tmp_path / "r").iterdir()) == ["batch=1", "batch=2"]


def test_numbers_of_a_stored_registry_go_on_past_32_bits(spark, tmp_path):
    path = str(tmp_path / "r")
    K.number_rows(members(spark, ["a"]), ["name"], "k", after=2**40).write.parquet(f"{path}/batch=1")
    assert held(K.register(members(spark, ["a", "b"]), path, "k")) == {"a": 2**40 + 1, "b": 2**40 + 2}


def test_an_empty_load(spark, tmp_path):
    path = str(tmp_path / "r")
    assert held(K.register(members(spark, []), path, "k")) == {}
    assert held(K.register(members(spark, ["x"]), path, "k")) == {"x": 1}


def test_star_loads_share_a_registry(spark, tmp_path):
    rows = [dict(customer_id=f"C{i}", customer=f"n{i}", city=f"t{i % 3}", product=f"p{i % 4}") for i in range(20)]
    a = S.build_star(spark, make(spark, rows), str(tmp_path / "a"), registry=str(tmp_path / "keys"))
    old = {r.customer_id: r.customer_key for r in a.dim_customer.collect()}
    geo = {r.city: r.geography_key for r in a.dim_geography.collect()}
    more = rows[5:] + [dict(customer_id=c, customer=c, city="t9", product="p9", order_date=date(2024, 1, 1)) for c in ("A0", "Z9")]
    b = S.build_star(spark, make(spark, more), str(tmp_path / "b"), registry=str(tmp_path / "keys"))
    new = {r.customer_id: r.customer_key for r in b.dim_customer.collect()}
    assert set(new) == {r["customer_id"] for r in more}
    assert all(new[c] == k for c, k in old.items() if c in new)
    assert {new["A0"], new["Z9"]} == {21, 22}
    assert {r.city: r.geography_key for r in b.dim_geography.collect()} == geo | {"t9": 4}
    assert b.fact_sales.count() == len(more) and dict(b.fact_sales.dtypes)["customer_key"] == "bigint"


def test_members_come_from_one_scan(spark, tmp_path):
    path = str(tmp_path / "lines")
    make(spark, [dict(), dict(city=None, customer_id="C2")]).write.parquet(path)
    lines = spark.read.parquet(path)
    columns = [c for own in S.MEMBERS.values() for c in own]
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        lines.groupingSets(list(S.MEMBERS.values()), *columns).agg(F.grouping_id().alias("_set")).explain()
    assert out.getvalue().count("FileScan") == 1
    found = S.dimension_members(lines)
    assert {n: df.count() for n, df in found.items()} == {"dim_date": 1, "dim_customer": 2, "dim_product": 1, "dim_geography": 2}


def test_null_and_empty_members_are_told_apart_from_other_dimensions(spark):
    lines = make(spark, [dict(product=None, city=None, customer_id=None)])
    found = S.dimension_members(lines)
    assert [r[0] for r in found["dim_product"].collect()] == [None]
    assert found["dim_geography"].count() == found["dim_customer"].count() == 1
    with pytest.raises(ValueError):
        K.number_rows(lines, ["product"], "k", buckets=0)
