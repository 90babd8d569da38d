"""Reject table: every line read is accepted or rejected with a reason."""

import pytest
from pyspark.sql import types as T

from orderlens.sources import rejects as R
from orderlens.sources.csvfiles import EmptySource, MalformedSource, MissingSource

TARGET = T.StructType([T.StructField("sales", T.DoubleType()), T.StructField("day", T.DateType())])
HEAD = "name,sales,day"


def put(folder, name, *lines, mark=""):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(mark + "\n".join(lines) + "\n", encoding="utf-8")


def load(spark, folder, tmp_path):
    got = R.load_with_rejects(spark, str(folder), TARGET, str(tmp_path / "out"))
    return got, {r.reason: r.n_lines for r in got.counts().collect()}


def test_each_fault_has_its_reason(spark, tmp_path):
    d = tmp_path / "in"
    put(
        d, "a.csv", HEAD, '"x, ""y""",1.5,2024-01-02', "short,1", "", "long,1,2024-01-01,9", "long,1,2024-01-01,9",
        "bad,abc,2024-13-01", "bad,1,2024-13-01", "NA,NA,NA", HEAD, 'open,1,"2024-01-01', "," * 30_000, mark="﻿",
    )
    put(d, "b.csv", HEAD, "z,2,2024-01-03")
    put(d, "c.csv", "day,sales,name", "2024-01-01,1,x")
    got, counts = load(spark, d, tmp_path)
    assert counts == {
        None: 3, "short line": 1, "blank line": 1, "long line": 3, "bad value: sales, day": 1, "bad value: day": 1,
        "repeated header": 1, "open quote": 1, "file with another header": 2,
    }
    n_lines = sum(len(p.read_text().splitlines()) for p in d.iterdir())
    assert sum(counts.values()) == n_lines - 2  # the headers of a and b
    rows = sorted((str(r.name), r.sales, str(r.day)) for r in got.accepted.collect())
    assert rows == [("None", None, "None"), ('x, "y"', 1.5, "2024-01-02"), ("z", 2.0, "2024-01-03")]
    twice = got.rejected.filter("line = 'long,1,2024-01-01,9'").collect()
    assert [(r.file.rsplit("/", 1)[1], r.n_lines) for r in twice] == [("a.csv", 2)]
    assert got.accepted.schema["sales"].dataType == T.DoubleType()


def test_only_a_header(spark, tmp_path):
    d = tmp_path / "in"
    put(d, "a.csv", HEAD)
    got, counts = load(spark, d, tmp_path)
    assert counts == {None: 0} and got.accepted.columns == ["name", "sales", "day"]


def test_blank_lines_before_the_header(spark, tmp_path):
    d = tmp_path / "in"
    put(d, "a.csv", "", " ", HEAD, "x,1,2024-01-01")
    put(d, "b.csv", "", "")
    assert load(spark, d, tmp_path)[1] == {None: 1, "blank line": 4}


def test_file_of_many_blocks(spark, tmp_path):
    d = tmp_path / "in"
    put(d, "a.csv", HEAD, *[f"n{i},{i},2024-01-01" for i in range(4000)], HEAD, "short")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert load(spark, d, tmp_path)[1] == {None: 4000, "repeated header": 1, "short line": 1}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_refusals(spark, tmp_path):
    with pytest.raises(MissingSource):
        load(spark, tmp_path / "absent", tmp_path)
    put(tmp_path / "empty", "a.csv", "", "")
    with pytest.raises(EmptySource):
        load(spark, tmp_path / "empty", tmp_path)
    put(tmp_path / "other", "a.csv", "name,sales", "x,1")
    with pytest.raises(MalformedSource):
        load(spark, tmp_path / "other", tmp_path)
    put(tmp_path / "twice", "a.csv", "name,sales,day,day", "x,1,2,3")
    with pytest.raises(MalformedSource):
        load(spark, tmp_path / "twice", tmp_path)


def test_the_whole_run_goes_on_without_the_misfits(spark, tmp_path):
    from orderlens import schema
    from orderlens.plans import pipeline

    head = ",".join(f.name for f in schema.SOURCE)
    good = "1,O1,2023-01-15,20230115,Ann,Korea,Seoul,APJ,East,Ltd,C1,Tech,SMB,Hub,K1,261.96,2,0.1,41.9136"
    put(tmp_path / "real", "a.csv", head, good, good.replace("1,O1", "2,O2", 1), "3,O3", good.replace("261.96", "much"))
    real, absent = str(tmp_path / "real"), str(tmp_path / "absent")
    out = pipeline.run(spark, real, absent, str(tmp_path / "t"), reject_path=str(tmp_path / "r"))
    assert sorted(r.order_id for r in out.lines.collect()) == ["O1", "O2"]
    assert {r.reason: r.n_lines for r in out.rejected.collect()} == {"short line": 1, "bad value: Sales": 1}
