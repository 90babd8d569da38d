"""Dimensions, fact load, integrity rules and the query library on small rows."""

from datetime import date

import pytest
from pyspark.sql import functions as F
from test_rules import make

from orderlens.operators import star as S
from orderlens.plans import library as L
from orderlens.sources.tables import write_observed

ROWS = [
    dict(order_id="ORD-1", product="FinanceHub", sales=1000, quantity=2, discount=0.1, profit=200),
    dict(order_id="ORD-1", product="Support", sales=500, profit=-50),
    dict(
        order_id="ORD-2", order_date=date(2023, 2, 20), customer="Globex", customer_id="C2", region="EMEA",
        country="DE", city="B", subregion="W", segment="Enterprise", industry="Energy", product="FinanceHub",
        sales=2000, quantity=4, discount=0.2, profit=400,
    ),
]


@pytest.fixture()
def star(spark, tmp_path):
    return S.build_star(spark, make(spark, ROWS), str(tmp_path / "star"))


def test_tables(star):
    assert star.dim_date.count() == 2 and star.dim_product.count() == 2
    assert sorted(r.customer_key for r in star.dim_customer.collect()) == [1, 2]
    assert star.fact_sales.count() == 3
    assert star.fact_sales.select("sale_id").distinct().count() == 3
    for df, cols in (
        (star.dim_date, S.DIM_DATE),
        (star.dim_customer, S.DIM_CUSTOMER),
        (star.dim_product, S.DIM_PRODUCT),
        (star.dim_geography, S.DIM_GEOGRAPHY),
    ):
        assert df.columns == cols


def test_surrogate_keys_are_gapless_and_stable(spark):
    df = spark.range(5000).select(F.concat(F.lit("c"), "id").alias("name"))
    a = S.number_rows(df, ["name"], "k", buckets=7)
    b = S.number_rows(df.repartition(5).orderBy(F.rand(1)), ["name"], "k", buckets=7)
    assert sorted(r.k for r in a.collect()) == list(range(1, 5001))
    assert sorted(a.collect()) == sorted(b.collect())
    with pytest.raises(ValueError):
        S.number_rows(df, ["name"], "k", buckets=0)


def test_reading_back(spark, star, tmp_path):
    again = S.read_star(spark, str(tmp_path / "star"))
    assert again.fact_sales.count() == 3 and again.dim_geography.count() == 2


def test_one_id_with_two_segments_fails_the_load(spark, tmp_path):
    bad = make(spark, [dict(segment="SMB"), dict(segment="Enterprise")])
    with pytest.raises(S.IntegrityError, match="unique\\(customer_id\\)"):
        S.build_star(spark, bad, str(tmp_path / "star"))


def test_null_geography_drops_the_line_unless_null_safe(spark, tmp_path):
    rows = make(spark, [dict(), dict(city=None)])
    with pytest.raises(S.IntegrityError, match="2 staging rows became 1 fact rows"):
        S.build_star(spark, rows, str(tmp_path / "a"))
    loose = S.build_star(spark, rows, str(tmp_path / "b"), null_safe_geography=True)
    assert loose.fact_sales.count() == 2


def test_orphans_are_found(spark, star):
    lone = S.Star(star.fact_sales, star.dim_date.limit(0), star.dim_customer, star.dim_product, star.dim_geography)
    found = {(r.table_name, r.rule): r.n_violations for r in S.constraint_violations(lone).collect()}
    assert found["fact_sales", "references(dim_date)"] == 3
    assert sum(found.values()) == 3
    with pytest.raises(S.IntegrityError):
        S.enforce(S.constraint_violations(lone))


def test_missing_order_id_and_repeated_sale_id(spark, tmp_path):
    rows = make(spark, [dict(order_id=None, line_seq=1), dict(line_seq=1)])
    loaded = S.build_star(spark, rows, str(tmp_path / "s"), sale_id="line_seq", check=False)
    found = {(r.table_name, r.rule): r.n_violations for r in S.constraint_violations(loaded).collect()}
    assert found["fact_sales", "not_null(order_id)"] == 1
    assert found["fact_sales", "unique(sale_id)"] == 1


def test_status_and_losses(star):
    status = {r.product_name: r.status for r in L.b1_product_health(star).collect()}
    assert status == {"FinanceHub": "HEALTHY", "Support": "LOSS-MAKING"}
    assert [tuple(r) for r in L.b2_loss_products(star).collect()] == [("Support", -50.0)]


def test_segment_discount_against_all_rows(star):
    # The mean over lines is 10 %; SMB lines average 5 %, the Enterprise line 20 %.
    out = [tuple(r) for r in L.b3_segments_above_average_discount(star).collect()]
    assert out == [("Enterprise", 20.0)]


def test_region_function(spark, star):
    want = {"total_sales": 1500.0, "total_profit": 150.0, "margin_pct": 10.0, "orders": 1.0}
    none = {"total_sales": None, "total_profit": None, "margin_pct": None, "orders": 0.0}
    L.register_views(spark, star)
    for frame in (L.e1_region_kpis(star, "AMER"), spark.sql("SELECT * FROM get_region_kpis('AMER')")):
        assert {r.metric: r.value for r in frame.collect()} == want
    for frame in (L.e1_region_kpis(star, "none"), spark.sql("SELECT * FROM get_region_kpis('none')")):
        assert {r.metric: r.value for r in frame.collect()} == none
    assert spark.table("vw_sales_enriched").columns == L.d1_sales_enriched(star).columns
    assert len(spark.table("vw_sales_enriched").columns) == 19
    assert spark.table("vw_monthly_kpis").count() == 2


def test_ties_keep_both_best_products(spark, tmp_path):
    rows = make(spark, [dict(product="a"), dict(product="b"), dict(product="c", sales=5)])
    star = S.build_star(spark, rows, str(tmp_path / "s"))
    assert [r.product_name for r in L.c2_best_product_by_region(star).collect()] == ["a", "b"]


def test_zero_sales_gives_null_not_an_error(spark, tmp_path):
    star = S.build_star(spark, make(spark, [dict(sales=0, profit=0)]), str(tmp_path / "s"))
    assert L.a2_region_sales(star).first().margin_pct is None
    assert L.c1_pareto(star).first().cumulative_pct is None
    assert L.d1_sales_enriched(star).first().profit_margin_pct is None
    assert L.b1_product_health(star).first().status == "HEALTHY"


def test_two_keys_with_one_name_count_an_order_once(spark, tmp_path):
    rows = make(spark, [dict(customer_id="C1"), dict(customer_id="C2"), dict(customer_id="C2", order_id="O2")])
    star = S.build_star(spark, rows, str(tmp_path / "s"))
    assert [tuple(r) for r in L.a3_top_customers(star).collect()] == [("Acme", 300.0, 2)]


def test_refresh_of_one_year_leaves_the_others(spark, tmp_path):
    rows = [dict(order_date=date(2022, 5, 1)), dict(order_date=date(2023, 5, 1))]
    path = str(tmp_path / "monthly")
    L.refresh_monthly_kpis(spark, S.build_star(spark, make(spark, rows), str(tmp_path / "a")), path)
    changed = [dict(r, sales=999) for r in rows]
    later = S.build_star(spark, make(spark, changed), str(tmp_path / "b"))
    out = L.refresh_monthly_kpis(spark, later, path, years=[2023])
    assert {r.year: r.sales for r in out.collect()} == {2022: 100.0, 2023: 999.0}


def test_counts_come_with_the_write(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 2020), (2, "a", 2021), (None, None, 2021)], "k int, t string, year int")
    measures = {"rows": F.count(F.lit(1)), "no_k": F.count_if(F.col("k").isNull()), "top": F.max("k")}
    back, seen = write_observed(df, str(tmp_path / "t"), measures, ("year",))
    assert seen == {"rows": 3, "no_k": 1, "top": 2} and back.count() == 3
    assert write_observed(df.limit(0), str(tmp_path / "e"), measures)[1] == {"rows": 0, "no_k": 0, "top": None}


def test_missing_values_stop_the_load(spark, tmp_path):
    with pytest.raises(S.IntegrityError, match=r"not_null\(order_id\): 1"):
        S.build_star(spark, make(spark, [dict(order_id=None), dict()]), str(tmp_path / "s"))


def test_observed_nulls_give_the_same_report(star):
    plain = {tuple(r) for r in S.constraint_violations(star).collect()}
    seen = {"sale_id": 0, "order_id": 0}
    assert {tuple(r) for r in S.constraint_violations(star, fact_nulls=seen).collect()} == plain and len(plain) == 18


def test_references_read_the_fact_once(star):
    plan = S.orphans(star)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and plan.count("Relation [") == 5
