"""Shards by histogram sort against a plain sort."""

import zlib

import numpy as np
import pytest
from orderlens.llm import queries, sharding
from orderlens.llm.ranges import find_splits
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_op8(spark, documents):
    got = queries.op8_histogram_shards(spark, SF).toPandas()
    docs = documents.set_index("doc_id")
    assert sorted(got.doc_id) == sorted(docs.index)
    raw = [docs.text[d].encode() for d in got.doc_id]
    assert got["size"].tolist() == [len(r) + 16 for r in raw]
    assert got.text_crc32.tolist() == [zlib.crc32(r) for r in raw]
    assert set(got.shard) <= set(range(40)) and set(got.law) == {"bytes"} and got.grown_shard.isna().all()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    mean = got["size"].sum() / 40
    # a border can miss its aim by half a row at most, here rows are up to half a shard
    assert (got.groupby("shard")["size"].sum() - mean).abs().max() <= got["size"].max()


@pytest.mark.parametrize("piece_bytes", [10**9, 3000])
def test_slots_follow_one_order(spark, documents, piece_bytes):
    docs = spark.createDataFrame(documents[["doc_id", "text"]])
    got = sharding.histogram_shards(docs, 7, piece_bytes).withColumn("key", F.xxhash64("text")).toPandas()
    got = got.sort_values(["shard", "slot"])
    assert got[["key", "doc_id"]].values.tolist() == sorted(got[["key", "doc_id"]].values.tolist())
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    sizes = got.text.map(lambda t: len(t.encode()) + 16).groupby(got.shard).sum()
    assert sizes.max() / sizes.min() < 1.25


def test_hot_group_is_parted_and_small_groups_stay_whole(spark):
    rows = [(i, "same text") for i in range(600)] + [(1000 + i, f"text {i % 300}") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.histogram_shards(docs, 5, 500).toPandas()
    sizes = got.text.str.len().add(16).groupby(got.shard).sum()
    assert len(sizes) == 5 and sizes.max() / sizes.min() < 1.05
    assert got[got.text == "same text"].shard.nunique() >= 2
    assert (got[got.text != "same text"].groupby("text").shard.nunique() > 1).sum() <= 4
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_odd_rows_and_files(spark, odd_docs, no_docs, tmp_path):
    got = sharding.histogram_shards(odd_docs, 3)
    assert got.count() == 10 and got.where("doc_id is null").count() == 1
    sharding.write_shards(got, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(map(str, back.select("doc_id", "shard", "slot").collect())) == sorted(
        map(str, got.select("doc_id", "shard", "slot").collect())
    )
    assert sharding.histogram_shards(no_docs, 3).collect() == []


def test_splits_meet_the_tolerance(spark):
    rng = np.random.default_rng(1)
    keys = np.concatenate([rng.integers(-(2**63), 2**63 - 1, 3000), rng.integers(0, 50, 3000)])
    weights = rng.integers(1, 40, 6000)
    rows = spark.createDataFrame(
        [(int(k), i, int(w)) for i, (k, w) in enumerate(zip(keys, weights, strict=True))], "key long, id long, weight long"
    )
    s = find_splits(rows, 16, 0.01)
    piece = s.place(keys, np.arange(6000))
    sums = np.bincount(piece, weights, 16)
    assert np.abs(sums - weights.sum() / 16).max() < 0.05 * weights.sum() / 16
    assert s.rows_below.tolist() == [0, *np.cumsum(np.bincount(piece, minlength=16))[:-1].tolist()]
    assert s.weight_below.tolist() == [0, *np.cumsum(sums).astype(int)[:-1].tolist()]
