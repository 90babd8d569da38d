"""The small two-order frame, with results worked by hand."""

import pytest
from fixture_frame import FIXTURE_ROWS, raw_frame
from pyspark.sql import functions as F

from orderlens.operators import clean, kpis, measures
from orderlens.operators.features import engineer_features, with_discount_bucket
from orderlens.plans import report


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_column_names_become_snake_case(raw):
    out = clean.clean_column_names(raw)
    assert {"order_id", "customer_id"} <= set(out.columns)
    assert not any(" " in c for c in out.columns)


def test_other_whitespace_stays(spark):
    df = spark.createDataFrame([(1, 2)], ["  Row ID ", "a\tB"])
    assert clean.clean_column_names(df).columns == ["row_id", "a\tb"]


def test_percent_discounts_are_rescaled(raw):
    df = clean.clean_column_names(raw).withColumn("discount", F.col("discount") * 100)
    out = clean.clean_data(df)
    assert sorted(r.discount for r in out.collect()) == pytest.approx([0.0, 0.1, 0.2])


def test_a_discount_of_exactly_one_is_not_percent_form(raw):
    df = clean.clean_column_names(raw).withColumn("discount", F.col("discount") * 5)
    assert df.agg(F.max("discount")).first()[0] == 1.0
    assert clean.rescale_discount(df).agg(F.max("discount")).first()[0] == 1.0


def test_rescale_is_decided_for_the_whole_set_and_ignores_nan(spark):
    df = spark.createDataFrame([(0.5,), (20.0,), (None,)], "discount double")
    assert {r.discount for r in clean.rescale_discount(df).collect()} == {0.005, 0.2, None}
    odd = spark.createDataFrame([(0.5,), (float("nan"),)], "discount double")
    assert 0.5 in {r.discount for r in clean.rescale_discount(odd).collect()}


def test_exact_duplicates_are_removed(spark):
    df = clean.clean_column_names(raw_frame(spark, [*FIXTURE_ROWS, FIXTURE_ROWS[0]]))
    out = clean.clean_data(df)
    assert out.count() == 3
    assert clean.removed_duplicates(df, out).first().rows_removed == 1


def test_row_numbers_keep_duplicates_unless_ignored(spark):
    df = clean.clean_column_names(raw_frame(spark, [*FIXTURE_ROWS, FIXTURE_ROWS[0]]))
    numbered = df.coalesce(1).withColumn("row_id", F.monotonically_increasing_id())
    assert clean.drop_duplicates(numbered).count() == 4
    kept = clean.drop_duplicates(numbered, ignore=["row_id", "license"])
    assert kept.columns == numbered.columns
    assert sorted(r.row_id for r in kept.collect()) == [0, 1, 2]


def test_bad_dates_become_null_and_are_counted(spark):
    rows = [("2023-01-15", *r[2:]) for r in FIXTURE_ROWS]
    texts = ["2023-01-15", "15.01.2023", None]
    df = clean.clean_column_names(
        raw_frame(spark, [("O", t, *r[1:]) for t, r in zip(texts, rows, strict=True)])
    )
    out = clean.clean_data(df)
    assert out.count() == 3
    assert out.filter("order_date is null").count() == 2
    report_rows = {r.rule: r.n_rows for r in clean.quality_report(df).collect()}
    assert report_rows["unparseable_order_date"] == 2
    featured = engineer_features(out).filter("order_date is null").first()
    assert featured.year is None and featured.year_month is None


def test_features(lines):
    rows = {(r.order_id, r["product"]): r for r in lines.collect()}
    first, support, last = rows["ORD-1", "FinanceHub"], rows["ORD-1", "Support"], rows["ORD-2", "FinanceHub"]
    assert sum(r.is_loss for r in rows.values()) == 1 and support.is_loss
    assert [first.revenue_band, support.revenue_band, last.revenue_band] == ["250-1K", "250-1K", "1K-5K"]
    assert {r.revenue_per_unit for r in rows.values()} == {500.0}
    assert (first.year, first.month, first.month_name, first.quarter) == (2023, 1, "Jan", 1)
    assert (last.year_month, last.date_key, last.discount_pct) == ("2023-02", 20230220, 20.0)
    assert support.profit_margin == pytest.approx(-0.1)


def test_order_rollup(lines):
    out = by(kpis.build_order_level(lines), "order_id")
    assert len(out) == 2
    one, two = out["ORD-1"], out["ORD-2"]
    assert (one.order_sales, one.order_profit, one.n_lines) == (1500.0, 150.0, 2)
    assert (two.order_sales, two.order_profit, two.n_lines) == (2000.0, 400.0, 1)
    assert (one.customer, one.region, one.segment) == ("Acme", "AMER", "SMB")


def test_headline_counts_orders_not_rows(lines):
    k = kpis.headline_kpis(lines).first()
    assert (k.n_orders, k.n_customers, k.total_sales, k.total_profit) == (2, 2, 3500.0, 550.0)
    assert k.avg_order_value == pytest.approx(1750.0)
    assert k.avg_discount_pct == pytest.approx(10.0)
    assert k.profit_margin_pct == pytest.approx(550 / 3500 * 100)
    mean_of_margins = lines.agg(F.avg("profit_margin")).first()[0] * 100
    assert k.profit_margin_pct != pytest.approx(mean_of_margins)


def test_breakdowns(lines):
    rows = [tuple(r) for r in kpis.breakdown(lines, "region").collect()]
    assert rows == [("EMEA", 2000.0, 400.0, 20.0, 1, 20.0), ("AMER", 1500.0, 150.0, 5.0, 1, 10.0)]
    rows = [tuple(r) for r in kpis.breakdown(lines, "product").collect()]
    assert rows == [("FinanceHub", 3000.0, 600.0, 15.0, 2, 20.0), ("Support", 500.0, -50.0, 0.0, 1, -10.0)]
    many = kpis.breakdowns(lines, ["region", "product"]).collect()
    assert {(r.dimension, r.key) for r in many} == {
        ("region", "EMEA"), ("region", "AMER"), ("product", "FinanceHub"), ("product", "Support"),
    }


def test_top_customers(lines):
    rows = [tuple(r) for r in kpis.top_customers(lines).collect()]
    assert rows == [("Globex", 2000.0, 57.1), ("Acme", 1500.0, 42.9)]
    share = kpis.top_share(lines).first()
    assert share.sum_of_rounded_pct == pytest.approx(100.0, abs=0.1)
    assert share.exact_pct == 100.0


def test_discount_buckets(lines):
    from orderlens.plans.library import c6_discount_margin

    rows = [tuple(r) for r in c6_discount_margin(lines).collect()]
    assert rows == [
        ("0%", 1, 500.0, -50.0, -10.0), ("1-10%", 1, 1000.0, 200.0, 20.0), ("11-20%", 1, 2000.0, 400.0, 20.0),
    ]
    assert with_discount_bucket(lines).filter("bucket_order = 1").count() == 1


def test_losses(lines):
    k = kpis.loss_lines(lines).first()
    assert (k.loss_lines, k.total_lines, k.loss_pct) == (1, 3, 33.3)
    assert [tuple(r) for r in kpis.loss_by_product(lines).collect()] == [("Support", -50.0)]


def test_cumulative_share(lines):
    rows = by(measures.cumulative_share(lines), "customer")
    share = {c: round(r.cumulative / r.whole * 100, 1) for c, r in rows.items()}
    assert share == {"Globex": 57.1, "Acme": 100.0}


def test_report_has_all_sections(lines):
    rows = report.run_eda(lines).collect()
    assert {r.section for r in rows} == {
        "headline", "lines", "by_region", "by_segment", "by_industry", "by_product", "top_customers",
        "loss_by_product",
    }
    values = {(r.section, r.key, r.metric): r.value for r in rows}
    assert values["headline", "all", "avg_order_value"] == 1750.0
    assert values["top_customers", "all", "top_share_pct"] == pytest.approx(100.0)
