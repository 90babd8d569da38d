"""Readers, writers, the generator, and the run from file to report."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from orderlens import schema
from orderlens.operators import clean, profile
from orderlens.plans import pipeline, registry, warehouse
from orderlens.sources import csvfiles as R
from orderlens.sources.tables import write_csv, write_table

HEADER = ",".join(f.name for f in schema.SOURCE)
LINE = (
    '1,O1,2023-01-15,20230115,Ann,"Korea, South",Seoul,APJ,East,"Say ""Hi"" Ltd",C1,Tech,SMB,Hub,K1,'
    "261.96,2,0.1,41.9136"
)


def put(path, *rows):
    path.write_text("\n".join(rows) + ("\n" if rows else ""))
    return str(path)


def test_quotes_types_and_missing_tokens(spark, tmp_path):
    gaps = "2,O2,NA,,,,,,,null,C2,,,,,n/a,,NaN,"
    r = R.read_orders(spark, put(tmp_path / "f.csv", HEADER, LINE, gaps)).orderBy("Row ID").collect()
    assert r[0]["Country"] == "Korea, South" and r[0]["Customer"] == 'Say "Hi" Ltd'
    assert (r[0]["Sales"], r[0]["Quantity"], r[0]["Profit"]) == (261.96, 2, 41.9136)
    assert [r[1][c] for c in ("Order Date", "Customer", "Sales", "Quantity", "Discount")] == [None] * 5


def test_columns_are_taken_by_name(spark, tmp_path):
    df = R.read_orders(spark, put(tmp_path / "f.csv", "Sales,Extra,Order ID", "2.5,x,O1"))
    assert df.columns == ["Sales", "Extra", "Order ID"]
    assert df.first()["Sales"] == 2.5


def test_distinct_errors(spark, tmp_path):
    with pytest.raises(R.MissingSource):
        R.read_orders(spark, str(tmp_path / "absent.csv"))
    with pytest.raises(R.EmptySource):
        R.read_orders(spark, put(tmp_path / "empty.csv"))
    assert R.read_orders(spark, put(tmp_path / "header.csv", HEADER)).count() == 0
    long = put(tmp_path / "long.csv", "Sales,Quantity", "1,2", "1,2,3")
    with pytest.raises(R.MalformedSource):
        R.verify(R.read_orders(spark, long))
    assert R.read_orders(spark, long, strict=False).count() == 2
    wrong = put(tmp_path / "wrong.csv", "Sales,Quantity", "1,2", "abc,3")
    with pytest.raises(R.MalformedSource):
        R.verify(R.read_orders(spark, wrong))
    assert R.read_orders(spark, wrong, strict=False).filter("Sales is null").count() == 1
    raw = R.read_text_table(spark, wrong)
    target = type(schema.SOURCE)([f for f in schema.SOURCE if f.name in ("Sales", "Quantity")])
    assert {r.column: r.n_rejected for r in R.reject_counts(raw, target).collect()} == {"Sales": 1, "Quantity": 0}


def test_line_breaks_inside_quotes(spark, tmp_path):
    path = put(tmp_path / "f.csv", "Customer,Sales", '"two', 'lines",1')
    assert R.read_text_table(spark, path, multi_line=True).first()["Customer"] == "two\nlines"


def test_fallback_order(spark, tmp_path):
    real, sample = str(tmp_path / "real.csv"), put(tmp_path / "sample.csv", HEADER, LINE)
    assert R.load_data(spark, real, sample).first().source_kind == "sample"
    put(tmp_path / "real.csv", HEADER, LINE, LINE)
    assert R.load_data(spark, real, sample).count() == 2
    assert R.resolve_source(spark, real, sample).kind == "real"
    with pytest.raises(R.MissingSource):
        R.load_data(spark, str(tmp_path / "x"), str(tmp_path / "y"))


def test_run_from_file_to_report(spark, tmp_path):
    sample = str(tmp_path / "sample")
    given = warehouse.lines(spark, "/root/testdata/sf0.001")
    write_csv(registry.source_form(given), sample)
    n_orders = given.select("order_id").distinct().count()
    out = pipeline.run(spark, str(tmp_path / "real"), sample, str(tmp_path / "t"), str(tmp_path / "csv"))
    assert out.lines.columns == [*schema.CLEAN_COLUMNS, "line_seq"]
    assert out.lines.count() == out.raw.count()
    assert {r.rule: r.n_rows for r in out.quality.collect()}["negative_sales"] == 0
    values = {(r.section, r.key, r.metric): r.value for r in out.report.collect()}
    assert values["headline", "all", "n_orders"] == n_orders
    staged = R.read_staging(spark, str(tmp_path / "csv"))
    assert staged.schema == schema.STAGING and staged.count() == out.lines.count()
    bi = R.read_bi(spark, str(tmp_path / "csv"))
    assert dict(bi.dtypes)["sales"] == "double" and dict(bi.dtypes)["year"] == "bigint"
    assert {r.column: r.n_too_long for r in R.too_long(staged).collect()}["segment"] == 0


def test_staging_refuses_misfits(spark, tmp_path):
    good = dict.fromkeys(schema.CLEAN_COLUMNS, "")
    row = ",".join((good | {"quantity": "two"}).values())
    path = put(tmp_path / "s.csv", ",".join(schema.CLEAN_COLUMNS), row)
    with pytest.raises(PySparkException):
        R.read_staging(spark, path).collect()
    short = put(tmp_path / "h.csv", "order_id,sales", "a,1")
    with pytest.raises(R.MalformedSource):
        R.read_staging(spark, short)


def test_too_long_texts(spark):
    df = spark.createDataFrame([("x" * 11, "ok"), ("y", "z" * 21)], "region string, order_id string")
    assert {(r.column, r.limit): r.n_too_long for r in R.too_long(df).collect()} == {
        ("region", 10): 1, ("order_id", 20): 1,
    }


def test_table_keeps_rows_without_year(spark, tmp_path):
    df = spark.createDataFrame([(1, 2020), (2, None)], "a int, year int")
    back = write_table(df, str(tmp_path / "t"), ("year",))
    assert sorted((r.a, r.year) for r in back.collect() if r.year) == [(1, 2020)]
    assert back.count() == 2 and back.columns == ["a", "year"]


def test_profile(spark):
    df = spark.createDataFrame(
        [(1.0, "a"), (2.0, None), (float("nan"), "a"), (1.0, "a"), (1.0, "a")], "x double, t string"
    )
    assert tuple(profile.shape(df).first()) == (5, 2)
    assert [tuple(r) for r in profile.column_types(df).collect()] == [(0, "x", "double"), (1, "t", "string")]
    assert {r.column: r.n_missing for r in profile.missing_values(df).collect()} == {"x": 1, "t": 1}
    assert profile.duplicate_rows(df).first().n_duplicates == 2
    s = profile.numeric_summary(df).collect()
    assert [tuple(r) for r in s] == [("x", 4.0, 1.25, 0.5, 1.0, 1.0, 1.0, 1.25, 2.0)]
    assert profile.numeric_summary(df, approximate=True).first().p50 == 1.0
    assert set(profile.inspect_data(df)) == {"shape", "types", "missing", "duplicates", "summary"}
