"""The aggregate that follows its files, against the plain view over the files that are there."""

import shutil

import pytest
from pyspark.sql import functions as F

from orderlens.plans import library
from orderlens.sources import incremental as I

SCHEMA = "order_id string, date_key int, sales decimal(12,2), profit decimal(12,2)"


def write(spark, rows, path):
    spark.createDataFrame([(o, d, float(s), float(p)) for o, d, s, p in rows], "order_id string, date_key int, s double, p double").select(
        "order_id", "date_key", F.col("s").cast("decimal(12,2)").alias("sales"), F.col("p").cast("decimal(12,2)").alias("profit")
    ).coalesce(1).write.parquet(str(path))


def plain(*files):
    months = {}
    for rows in files:
        for o, d, s, p in rows:
            if d is not None:
                m = months.setdefault((d // 10000, d // 100 % 100), [0.0, 0.0, set()])
                m[0] += s
                m[1] += p
                m[2] |= {o} - {None}
    return sorted((y, m, round(s, 2), round(p, 2), len(o)) for (y, m), (s, p, o) in months.items())


def rows(df):
    return sorted((r.year, r.month, r.sales, r.profit, r.orders) for r in df.collect())


A = [("o1", 20220105, 10, 1), ("o2", 20220110, 20, 2), ("o3", 20230301, 5, -1)]
B = [("o1", 20220120, 7, 1), ("o9", 20220201, 8, 0), (None, 20220202, 9, 0), ("o4", None, 1, 1)]
C = [("o3", 20230302, 100, 10), ("o5", 20240101, 50, 5)]


@pytest.fixture()
def kept(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    return library.monthly_refresh(str(tmp_path / "root"), schema)


def test_files_come_and_go(spark, tmp_path, kept):
    source = tmp_path / "source dir+x"
    write(spark, A, source / "a")
    assert rows(kept.refresh(spark, str(source))) == plain(A)
    write(spark, B, source / "b" / "year=2022")
    assert rows(kept.refresh(spark, str(source))) == plain(A, B)
    write(spark, C, source / "c")
    assert rows(kept.refresh(spark, str(source))) == plain(A, B, C)
    shutil.rmtree(source / "b")
    assert rows(kept.refresh(spark, str(source))) == plain(A, C)
    shutil.rmtree(source / "c")
    assert rows(kept.refresh(spark, str(source))) == plain(A)
    assert rows(kept.refresh(spark, str(source))) == plain(A)


def test_only_new_files_are_read(spark, tmp_path, kept, monkeypatch):
    source, read = tmp_path / "s", []
    count = I.MonthlyRefresh._count
    monkeypatch.setattr(I.MonthlyRefresh, "_count", lambda self, s, paths, batch: (read.append(paths), count(self, s, paths, batch)))
    write(spark, A, source / "a")
    kept.refresh(spark, str(source))
    write(spark, B, source / "b")
    kept.refresh(spark, str(source))
    kept.refresh(spark, str(source))
    assert [len(p) for p in read] == [1, 1] and "/b/" in read[1][0]
    shutil.rmtree(source / "a")  # what is gone is taken back without its file
    assert rows(kept.refresh(spark, str(source))) == plain(B) and len(read) == 2


def test_a_changed_file_is_counted_anew(spark, tmp_path, kept):
    source = tmp_path / "s"
    write(spark, A, source / "a")
    kept.refresh(spark, str(source))
    old = next((source / "a").glob("*.parquet"))
    write(spark, C, tmp_path / "other")
    shutil.copy(next((tmp_path / "other").glob("*.parquet")), old)
    (old.parent / f".{old.name}.crc").unlink(missing_ok=True)
    assert rows(kept.refresh(spark, str(source))) == plain(C)


def test_a_refresh_that_broke_off_is_done_again(spark, tmp_path, kept, monkeypatch):
    source = tmp_path / "s"
    write(spark, A, source / "a")
    kept.refresh(spark, str(source))
    write(spark, C, source / "c")
    with monkeypatch.context() as m:
        def broken(spark, path):
            raise RuntimeError("lost")

        m.setattr(I.keys, "remove", broken)
        shutil.rmtree(source / "a")
        with pytest.raises(RuntimeError):  # merged, but years that lost their files are still there
            kept.refresh(spark, str(source))
    shutil.rmtree(source / "c")
    write(spark, B, source / "b")
    assert rows(kept.refresh(spark, str(source))) == plain(B)


def test_no_files(spark, tmp_path, kept):
    (tmp_path / "none").mkdir()
    assert rows(kept.refresh(spark, str(tmp_path / "none"))) == []
