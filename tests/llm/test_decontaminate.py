"""Window search against plain windows of words."""

import hashlib
import random
import re

import pandas as pd
import pytest
from orderlens.llm import decontaminate, queries
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, size=13):
    strings = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            strings.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    lengths = {len(s) for s in strings}
    out = []
    for text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if owners := strings.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= owners
        out.append((len(w), sorted(hit), sorted(found)))
    return out


def test_op10(spark, documents):
    bench = pd.read_parquet(f"{SF}/benchmark.parquet")
    want = plain(documents.text, zip(bench.item_id, bench.text, strict=True))
    got = queries.op10_decontaminate(spark, SF).toPandas().sort_values("doc_id")
    assert got.doc_id.tolist() == documents.doc_id.tolist()
    assert got.n_words.tolist() == [w[0] for w in want]
    assert got.n_hit.tolist() == [len(w[1]) for w in want]
    assert got.n_items.tolist() == [len(w[2]) for w in want]
    assert got.items_sha256.tolist() == [hashlib.sha256(",".join(w[2]).encode()).hexdigest() for w in want]
    assert got.contaminated.tolist() == [len(w[1]) > 0 and 20 * len(w[1]) >= w[0] for w in want]
    assert got.contaminated.any()


@pytest.mark.parametrize("seed", range(4))
def test_random_words(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "ab", "ba", "aab", "é", "日本", "x" * 9, "A", "B1"]
    sep = [" ", "  ", "\n", "-", ", ", "."]
    make = lambda n: "".join(rng.choice(vocabulary) + rng.choice(sep) for _ in range(rng.randint(0, n)))
    items = [(f"i{k}", make(14)) for k in range(25)] + [("none", None), ("long", make(14) + "q" * 400)]
    texts = [make(60) for _ in range(120)] + [items[3][1], items[-1][1], None, "", "...", "a", "aa"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.find_contamination(docs, bench, 5).orderBy("doc_id").collect()
    assert [(r.n_words, r.hit_words, r.item_ids) for r in got] == plain(texts, items, 5)


def test_blocks_of_items_give_the_same(spark, documents, monkeypatch):
    docs = spark.createDataFrame(documents[["doc_id", "text"]])
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    one = decontaminate.find_contamination(docs, bench).orderBy("doc_id").collect()
    strings = decontaminate.search_strings(bench, block_bytes=30_000)
    sizes = strings.groupBy("block").agg(F.sum(F.octet_length("string") + F.octet_length("item") + 64).alias("n")).collect()
    assert len(sizes) > 2 and all(r.n < 30_000 + 1000 for r in sizes)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 30_000)
    assert decontaminate.find_contamination(docs, bench).orderBy("doc_id").collect() == one


def test_items_without_an_id_hit_like_any_other(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a one two b"), (2, "three"), (3, "x")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "one two"), ("i", "two b"), (None, "three")], "item_id string, text string")
    got = {r.doc_id: (r.hit_words, r.item_ids, r.nameless) for r in decontaminate.find_contamination(docs, bench).collect()}
    assert got == {1: ([1, 2, 3], ["i"], True), 2: ([0], [], True), 3: ([], [], False)}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in queries.op10_decontaminate(spark, str(tmp_path)).collect()}
    assert rows == {1: (3, 2, True), 2: (1, 1, True), 3: (0, 0, False)}


def test_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame(
        [(1, "three FOUR five", 1), (1, None, 2), (None, "zero", 3)], "item_id int, text string, Text int"
    )
    got = decontaminate.find_contamination(odd_docs, bench)
    assert got.count() == 10
    hits = got.where("size(hit_words) > 0").collect()
    assert sorted((r.doc_id, r.hit_words, r.item_ids) for r in hits) == [(i, [2, 3, 4], ["1"]) for i in (1, 1, 7)]
    assert got.where("doc_id = 3").first().n_words == 0
    assert decontaminate.find_contamination(no_docs, bench).collect() == []
    assert decontaminate.find_contamination(odd_docs, bench.limit(0)).where("size(hit_words) > 0").count() == 0
