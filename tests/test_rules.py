"""Edge rules of columns, measures and time shifts on hand-made rows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from orderlens.functions import aggregates as A
from orderlens.functions import columns as C
from orderlens.operators import kpis, measures
from orderlens.operators.calendar import daily_sales, date_table, month_labels
from orderlens.operators.features import engineer_features
from orderlens.operators.measures import Slicers

COLUMNS = (
    "order_id string, order_date date, customer string, customer_id string, region string, segment string, "
    "industry string, product string, country string, city string, subregion string, contact_name string, sales decimal(12,2), quantity int, discount decimal(5,4), "
    "profit decimal(12,2), line_seq long"
)


def make(spark, rows):
    """Rows as dicts over sensible defaults."""
    base = dict(
        order_id="O1", order_date=date(2023, 1, 15), customer="Acme", customer_id="C1", region="AMER",
        segment="SMB", industry="Finance", product="Hub", country="X", city="Y", subregion="Z",
        contact_name="N", sales=100, quantity=1, discount=0, profit=10,
        line_seq=0,
    )
    from decimal import Decimal

    full = []
    for i, r in enumerate(rows):
        row = base | {"line_seq": i} | r
        for c in ("sales", "discount", "profit"):
            row[c] = None if row[c] is None else Decimal(str(row[c]))
        full.append(tuple(row.values()))
    return engineer_features(spark.createDataFrame(full, COLUMNS))


def one(df, column):
    return [r[column] for r in df.orderBy("line_seq").collect()]


def test_margin_and_unit_revenue_are_null_not_nan(spark):
    df = make(spark, [dict(sales=0), dict(quantity=0), dict(quantity=-2), dict(profit=None)])
    assert one(df, "profit_margin") == [None, 0.1, 0.1, None]
    assert one(df, "revenue_per_unit") == [0.0, None, None, 100.0]


def test_missing_profit_is_no_loss(spark):
    assert one(make(spark, [dict(profit=None), dict(profit=0), dict(profit=-0.01)]), "is_loss") == [
        False, False, True,
    ]


def test_revenue_bands_are_right_closed(spark):
    df = make(spark, [dict(sales=s) for s in (-5, 250, 250.01, 1000, 5000, 5000.01, None)])
    assert one(df, "revenue_band") == ["<250", "<250", "250-1K", "250-1K", "1K-5K", "5K+", None]


def test_discount_bucket_edges(spark):
    values = [0, 0.10, 0.1001, 0.20, 0.30, 0.31, None, -0.005, -0.5, 1.5]
    df = make(spark, [dict(discount=v) for v in values])
    df = df.withColumn("b", C.discount_bucket()).withColumn("cut", C.discount_bucket_cut())
    assert one(df, "b") == [
        "0%", "1-10%", "11-20%", "11-20%", "21-30%", "30%+", "30%+", "1-10%", "1-10%", "30%+",
    ]
    assert one(df, "cut") == [
        "0%", "1-10%", "11-20%", "11-20%", "21-30%", "30%+", None, "0%", None, None,
    ]


def test_bucket_edges_on_doubles(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (0.3,), (10 / 100,)], "discount double")
    assert [r[0] for r in df.select(C.discount_bucket()).collect()] == ["1-10%", "11-20%", "21-30%", "1-10%"]


def test_first_attribute_is_first_present_in_file_order(spark):
    rows = [
        dict(customer=None, region="B", line_seq=1),
        dict(customer="late", region="A", line_seq=5),
        dict(customer="early", region="C", line_seq=3),
    ]
    r = kpis.build_order_level(make(spark, rows)).first()
    assert (r.customer, r.region, r.n_lines) == ("early", "B", 3)


def test_missing_keys_and_sums(spark):
    df = make(spark, [dict(region=None), dict(region="A", sales=None, profit=None)])
    rows = kpis.breakdown(df, "region").collect()
    assert [(r.region, r.sales, r.margin_pct) for r in rows] == [("A", 0.0, None)]


def test_average_of_rounded_percentages(spark):
    df = make(spark, [dict(discount=0.1234), dict(discount=0.1)])
    assert kpis.breakdown(df, "region").first().avg_discount_pct == pytest.approx(11.15)
    assert kpis.headline_kpis(df).first().avg_discount_pct == pytest.approx(11.17)


def test_correlation_on_constant_and_partial_columns(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 5.0), (2.0, 4.5, 5.0), (3.0, None, 5.0), (4.0, 7.0, 5.0)], "x double, y double, c double"
    )
    constant, partial = df.select(A.safe_corr("x", "c"), A.safe_corr("x", "y")).first()
    assert constant is None
    pdf = df.toPandas()
    assert partial == pytest.approx(pdf.x.corr(pdf.y))
    cells = {(r.x, r.y): r.r for r in kpis.correlation_matrix(df, ["x", "y", "c"]).collect()}
    assert cells["x", "x"] == 1.0 and cells["c", "c"] is None and cells["x", "y"] == cells["y", "x"]


def test_top_customer_ties_break_by_name(spark):
    df = make(spark, [dict(customer=c) for c in ("b", "a", "c")])
    assert [r.customer for r in kpis.top_customers(df, 2).collect()] == ["a", "b"]


def test_hierarchy_nodes(spark):
    df = make(spark, [dict(region="R", industry="I"), dict(region="R", industry="J", sales=50)])
    nodes = {r.id: (r.label, r.parent, r.value) for r in kpis.hierarchy(df).collect()}
    assert nodes == {"R": ("R", "", 150.0), "R/I": ("I", "R", 100.0), "R/J": ("J", "R", 50.0)}


def gap_year(spark):
    """Sales in Jan and Mar 2022 and in Jan 2023; February has none."""
    return make(
        spark,
        [
            dict(order_date=date(2022, 1, 5), sales=100),
            dict(order_date=date(2022, 3, 5), sales=60, region="EMEA"),
            dict(order_date=date(2023, 1, 5), sales=150),
        ],
    )


def test_calendar_covers_whole_years(spark):
    days = date_table(gap_year(spark), "order_date")
    assert days.count() == 730
    first = days.orderBy("date").first()
    assert (first.date, first.month_year, first.quarter, first.year_month_sort) == (
        date(2022, 1, 1), "Jan 2022", "Q1", 202201,
    )
    assert [r.month_year for r in month_labels(days).limit(2).collect()] == ["Jan 2022", "Feb 2022"]
    daily = daily_sales(gap_year(spark), days)
    assert daily.count() == 730 and daily.agg(F.sum("sales")).first()[0] == 310.0


def test_time_measures_follow_calendar_months(spark):
    df = gap_year(spark)
    rows = {
        (r.year, r.month): r
        for r in measures.time_measures(df, date_table(df, "order_date")).collect()
    }
    assert len(rows) == 24
    assert rows[2022, 2].total_sales is None and rows[2022, 2].sales_mom == -1.0
    assert rows[2022, 3].sales_mom is None
    assert rows[2023, 1].sales_ly == 100.0 and rows[2023, 1].sales_yoy == pytest.approx(0.5)
    assert rows[2023, 3].sales_ly == 60.0 and rows[2023, 3].sales_yoy == -1.0
    assert rows[2022, 12].sales_ytd == 160.0 and rows[2023, 12].sales_ytd == 150.0
    assert rows[2023, 12].running_total == 310.0


def test_month_over_month_by_existing_month_differs(spark, tmp_path):
    from orderlens.operators.star import build_star
    from orderlens.plans.library import c3_month_over_month

    out = c3_month_over_month(build_star(spark, gap_year(spark), str(tmp_path / "star"))).collect()
    assert [(r.month, r.sales, r.mom_change, r.mom_pct) for r in out] == [
        (1, 100.0, None, None), (3, 60.0, -40.0, -40.0), (1, 150.0, 90.0, 150.0),
    ]


def test_date_slicers_keep_last_year_visible(spark):
    df = gap_year(spark)
    rows = measures.time_measures(df, date_table(df, "order_date"), slicers=Slicers(years=[2023])).collect()
    january = next(r for r in rows if r.month == 1)
    assert len(rows) == 12
    assert (january.sales_ly, january.running_total, january.sales_ytd) == (100.0, 150.0, 150.0)
    spring = Slicers(date_range=(date(2022, 2, 1), date(2022, 4, 30)))
    rows = measures.time_measures(df, date_table(df, "order_date"), slicers=spring).collect()
    assert [(r.month, r.running_total, r.sales_ytd) for r in sorted(rows, key=lambda r: r.month)] == [
        (2, None, 100.0), (3, 60.0, 160.0), (4, 60.0, 160.0),
    ]
    ragged = Slicers(date_range=(date(2022, 2, 3), date(2022, 3, 4)))
    rows = measures.time_measures(df, date_table(df, "order_date"), slicers=ragged).collect()
    assert [(r.month, r.total_sales, r.sales_ytd) for r in sorted(rows, key=lambda r: r.month)] == [
        (2, None, 100.0), (3, None, 100.0),
    ]


def test_time_measures_by_key(spark):
    df = gap_year(spark)
    rows = measures.time_measures(df, date_table(df, "order_date"), ["region"]).collect()
    assert len(rows) == 48
    emea = {(r.year, r.month): r for r in rows if r.region == "EMEA"}
    assert emea[2022, 2].running_total is None and emea[2023, 12].running_total == 60.0


def test_daily_last_year_on_leap_day(spark):
    df = make(
        spark,
        [dict(order_date=date(2023, 2, 28), sales=70), dict(order_date=date(2024, 2, 29), sales=5)],
    )
    rows = {r.date: r for r in measures.daily_time_measures(df, date_table(df, "order_date")).collect()}
    assert len(rows) == 365 + 366
    assert rows[date(2024, 2, 29)].sales_ly == 70.0 and rows[date(2024, 2, 28)].sales_ly == 70.0
    assert rows[date(2024, 12, 31)].running_total == 75.0 and rows[date(2024, 12, 31)].sales_ytd == 5.0


def test_slicers_and_share_of_total(spark):
    df = make(
        spark,
        [dict(region="A", segment="x"), dict(region="B", segment="x", sales=300), dict(region="B", segment="y")],
    )
    out = measures.evaluate(df, ["total_sales"], ["region"], Slicers({"segment": ["x"]}), share_of_total=True)
    assert {r.region: (r.total_sales, r.pct_of_total_sales) for r in out.collect()} == {
        "A": (100.0, 0.25), "B": (300.0, 0.75),
    }
    dated = Slicers(years=[2023], date_range=(date(2023, 1, 1), date(2023, 1, 31)))
    assert measures.evaluate(df, ["total_orders"], [], dated).first().total_orders == 1


def test_product_rank_scaffold_and_slicers(spark):
    df = make(
        spark,
        [
            dict(product="a", segment="x"),
            dict(product="b", segment="x", sales=100),
            dict(product="c", segment="x", sales=-5),
            dict(product="d", segment="y"),
        ],
    )
    products = df.select("product")
    ranks = lambda **k: {
        r["product"]: r.product_rank for r in measures.product_rank(df, products, **k).collect()
    }
    assert ranks(slicers=Slicers({"segment": ["x"]})) == {"a": 1, "b": 1, "d": 3, "c": 4}
    assert ranks(slicers=Slicers({"segment": ["x"], "product": ["c"]})) == {"c": 4}
    by_segment = measures.product_rank(df, products, ["segment"]).collect()
    # In segment x product d is absent, counts as zero, and outranks c.
    assert {(r.segment, r["product"]): r.product_rank for r in by_segment} == {
        ("x", "a"): 1, ("x", "b"): 1, ("x", "c"): 4, ("y", "d"): 1,
    }


def test_equal_revenues_share_the_running_total(spark):
    df = make(spark, [dict(customer=c, sales=s) for c, s in (("a", 50), ("b", 30), ("c", 30), ("d", 10))])
    rows = {r.customer: float(r.cumulative) for r in measures.cumulative_share(df).collect()}
    assert rows == {"a": 50.0, "b": 110.0, "c": 110.0, "d": 120.0}
