"""Pair-bound search against scores of all documents."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import database, differences
from orderlens.llm import common, queries, search

SF = "/root/testdata/sf0.01"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def plain(docs, items, k):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    n_all, length = len(held), sum(len(w) for _, w in held)
    df = {}
    for _, w in held:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        asked = {t: math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) for t in set(terms(text)) if t in df}
        scores = []
        for i, w in held:
            m = 50 + (50 * len(w) * n_all) // length
            s = sum(x * ((10**9 * w.count(t)) // (1000 * w.count(t) + 20 * m)) for t, x in asked.items() if t in w)
            if s > 0:
                scores.append((-s, i is not None, i))
        for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out.append((item, rank, i, -s))
    return sorted(out, key=str)


def found(spark, docs, items, k):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id string, text string")
    rows = search.search(search.build(d), q, k).collect()
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in rows), key=str)


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 40)))) for i in range(n)]
    items = [(f"q{i}", " ".join(rng.choices(vocabulary, k=rng.randint(1, 12)))) for i in range(15)]
    return docs, items


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_many_segments_and_blocks(spark, monkeypatch, k):
    for name, value in {"SEGMENT_DOCS": 40, "STRETCH": 8, "BLOCK_BYTES": 400, "FAN": 2}.items():
        monkeypatch.setattr(search, name, value)
    docs, items = corpus(400, 7)
    assert found(spark, docs, items, k) == plain(docs, items, k)


def test_odd_rows(spark):
    docs = [
        (1, "Apple pie, apple-tart; É clair"),
        (1, "Apple pie, apple-tart; É clair"),
        (None, "apple pie"),
        (2, "apple pie"),
        (3, None),
        (4, ""),
        (5, " .,;\n"),
        (6, "pie " * 50_000 + "apple"),
        (-9, "é éclair 日本 x1"),
    ]
    items = [("a", "APPLE pie"), ("a", "clair é É"), (None, "pie pie"), ("b", None), ("c", "?!"), ("d", "unknown words")]
    assert found(spark, docs, items, 3) == plain(docs, items, 3)


def test_long_texts_are_counted_in_slices(monkeypatch):
    monkeypatch.setattr(search, "SLICE", 10)
    text = "one two three four " * 50
    assert search.term_counts(text.encode()) == {w.encode(): 50 for w in ("one", "two", "three", "four")}


def test_nothing_to_search(spark, no_docs):
    assert found(spark, [], [("a", "x")], 5) == []
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id string, text string")
    assert search.search(search.build(docs), none, 5).collect() == []


def test_pairs_tighten_bounds_and_skip_postings():
    """Two heavy terms that never meet are bounded by the greater one, so lists behind them are skipped."""
    rng = np.random.default_rng(3)
    n = 4000
    words = [["a"] if i % 2 else ["b"] for i in range(n)]
    for w in words:
        w += ["c"] * int(rng.integers(0, 2)) + ["d"] * int(rng.integers(0, 2)) + ["e"] * int(rng.integers(1, 4))
    segment = search._Segment()
    for i, w in enumerate(words):
        segment.add(i, " ".join(w).encode())
    names = [p.split(" ")[0] for p in search.INDEX.split(", ")]
    row = dict(zip(names, segment.row(0), strict=True))
    plan = [{"query": 0, "terms": [b"a", b"b", b"c", b"d", b"e"], "weights": [900, 890, 300, 290, 10]}]
    load = search.Workload.of(plan)
    lists = search.SegmentLists(search._lists_of(row, load, n, sum(map(len, words))), load)
    order = load.queries[0][1]
    alone, paired = lists.bounds(order, pairs=False), lists.bounds(order)
    assert (paired <= alone).all() and paired[0].sum() < alone[0].sum()
    with_pairs, without = search.best_of_segment(lists, order, 10, 0), search.best_of_segment(lists, order, 10, 0, pairs=False)
    for found_ in (with_pairs, without):
        best = sorted(zip(-found_[1], found_[0], strict=True))[:10]
        assert [int(-s) for s, _ in best] == sorted((int(s) for s in all_scores(lists, order)), reverse=True)[:10]
    # a score that an earlier segment has set: only pairs show that it is out of reach
    out_of_reach = int(paired[0].max()) + 1
    assert out_of_reach <= alone[0].min()
    empty, read = search.best_of_segment(lists, order, 10, out_of_reach), search.best_of_segment(lists, order, 10, out_of_reach, pairs=False)
    assert len(empty[0]) == len(read[0]) == 0 and empty[2] == 0 < read[2]


def all_scores(lists, order):
    scores = np.zeros(lists.n_docs, np.int64)
    for t in order:
        docs, impacts = lists.postings(int(t))
        scores[docs] += lists.load.weights[t] * impacts.astype(np.int64)
    return scores


def test_op12_equals_its_twin(spark):
    want = database(SF).sql(queries.ORACLES["op12_pair_bound_search"]).to_arrow_table()
    assert differences(queries.op12_pair_bound_search(spark, SF).toArrow(), want) == []


def test_a_task_holds_one_segment_at_a_time(spark, monkeypatch):
    """Segments of one partition are row groups of their own, and rows go to Python one by one."""
    monkeypatch.setattr(search, "SEGMENT_DOCS", 40)
    docs, _ = corpus(400, 7)
    index = search.build(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    stored = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in index.segments.inputFiles()]
    groups = [m.row_group(i).num_rows for m in stored for i in range(m.num_row_groups)]
    assert groups == [1] * 10
    lengths = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with common.arrow_rows(spark, 1):
        sent = index.segments.select("segment").mapInArrow(lengths, "n long").collect()
    assert [r.n for r in sent] == [1] * 10 and spark.conf.get(key) == before
