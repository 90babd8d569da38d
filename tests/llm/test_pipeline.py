"""The pipeline's stages, each on what the one before it kept."""

import re
from pathlib import Path

import corpus_pipeline
import pytest
from orderlens.llm import common, near_dedup, stages
from orderlens.session import shared_dir
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_all_stages(spark):
    docs = given = spark.read.parquet(f"{SF}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        left[name] = docs.count()
        assert docs.schema.names == given.schema.names and [f.dataType for f in docs.schema] == [f.dataType for f in given.schema]
    assert 800 < left["toxicity"] < 1000 and left["near_dedup"] <= left["line_dedup"] < left["toxicity"]
    assert left["decontamination"] < left["near_dedup"]
    assert docs.where(F.char_length("text") != F.col("n_chars")).count() == 0
    packed = stages.packing_(spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()
    rows = corpus_pipeline.run(spark, SF)
    assert rows.agg(F.sum("length")).first()[0] == packed.agg(F.sum("length")).first()[0]


def test_near_dedup_keeps_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(5, text), (3, text + " end"), (9, "something else entirely here now"), (1, None), (2, None), (4, "")]
    kept = stages.near_dedup_(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 9]


def test_near_dedup_judges_rows_that_share_an_id_or_have_none(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(3, text), (None, text + " end"), (None, "quite another text that no one repeats"), (None, ""), (None, None)]
    rows += [(9, "start " + text), (9, "one more text of the id nine"), (7, "the same row twice"), (7, "the same row twice")]
    kept = stages.near_dedup_(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), SF)
    want = [rows[0], rows[2], rows[3], rows[4], rows[6], rows[7]]
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_stages_hand_on_other_columns_and_odd_rows(spark, odd_docs, no_docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd_docs, SF).schema.names == odd_docs.schema.names
        assert stage(spark, no_docs, SF).collect() == []
    clean = stages.decontamination(spark, odd_docs, SF)
    assert sorted(map(str, clean.collect())) == sorted(map(str, odd_docs.collect()))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").select("text").first()[0]
    dirty = spark.createDataFrame([(1, bench), (2, "a clean text"), (1, "of the same id")], "doc_id long, text string")
    assert sorted(r.text for r in stages.decontamination(spark, dirty, SF).collect()) == ["a clean text", "of the same id"]
    twice = spark.createDataFrame([(1, "a b c d\nkept line here now", 9), (2, "a b c d", 7)], "doc_id long, text string, n_chars int")
    got = stages.line_dedup_(spark, twice, SF).collect()
    assert [(r.doc_id, r.n_chars) for r in got] == [(1, 9)]


@pytest.fixture()
def near_copies(spark):
    """3,000 texts of their own, and near copies of two of them."""
    texts = [" ".join(f"w{i}x{k}" for k in range(30)) for i in range(3000)]
    rows = [*enumerate(texts), (4000, texts[5] + " end"), (4001, texts[5] + " fin"), (4002, texts[9] + " end")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.fixture()
def small_broadcasts(spark):
    """As at size, where only lists of few rows are sent to all tasks."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "8k")
    yield
    spark.conf.set(name, before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_near_dedup_shuffles_no_text_for_a_few_copies(spark, monkeypatch, near_copies, small_broadcasts):
    plans = {}

    def kept_plan(df, label, **options):
        plans[label] = plan(df)
        return common.stage(df, label, **options)

    monkeypatch.setattr(near_dedup, "stage", kept_plan)
    kept = stages.near_dedup_(spark, near_copies, SF)
    assert "Join" not in plans["sets"] and "hashpartitioning(row" not in plan(kept)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == set(range(3000))


def test_what_only_a_stage_reads_is_deleted_with_it(spark, near_copies):
    folder = Path(re.sub("^file:", "", shared_dir(spark)))
    before = set(folder.glob("corpus-*/*"))
    frames = [stages.line_dedup_(spark, near_copies, SF), stages.near_dedup_(spark, near_copies, SF)]
    new = {p.name.split("-")[-1] for p in set(folder.glob("corpus-*/*")) - before}
    assert new == {"lines", "similar", "rows", "repeated"}
    assert [f.count() for f in frames] == [3000, 3000]


def test_results_outlive_their_scratch(spark):
    ids = spark.range(3)
    with common.scratch(spark):
        with common.scratch(spark):
            inner, lost = common.stage(ids, "inner", result=True), common.stage(ids, "lost")
        outer = common.stage(inner, "outer", result=True)
    assert outer.count() == 3
    for gone in (inner, lost):
        with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
            gone.collect()
