"""Near-duplicates and line de-duplication against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from compare import database, differences
from orderlens.llm import line_dedup, near_dedup, queries
from orderlens.llm.components import connected

SF = "/root/testdata/sf0.01"
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def shingles(text, size):
    w = words(text)
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def components(docs, size):
    sets = {i: shingles(t, size) for i, t in docs}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_op2_equals_its_twin(spark):
    want = database(SF).sql(queries.ORACLES["op2_odd_sketches"]).to_arrow_table()
    assert differences(queries.op2_odd_sketches(spark, SF).toArrow(), want) == []


@pytest.mark.parametrize("block", [1024, 16])
def test_a_large_group_of_copies(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        docs.append((i, " ".join(w)))
    docs += [(1000 + i, " ".join(rng.choices(base, k=40))) for i in range(60)] + [(2000 + i, "same few words here") for i in range(50)]
    rng.shuffle(docs)
    got = near_dedup.cluster(spark.createDataFrame(docs, "doc_id long, text string"), 4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components(docs, 4)


def test_near_dedup_of_odd_rows(spark, odd_docs, no_docs):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.cluster(odd_docs, 4).collect()), key=str)
    assert got == sorted(
        [(-4, 1, -4), (1, 3, 1), (1, 3, 1), (2, 0, 2), (3, 0, 3), (5, 0, 5), (6, 2, 6), (7, 3, 1), (2**62, 2, 2**62), (None, 4, None)],
        key=str,
    )
    assert near_dedup.cluster(no_docs, 4).collect() == []


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(2)
    for share in (0.7, 0.8, 0.9, 1.0):
        n = 4000
        common = rng.integers(0, 2**63, n, dtype=np.uint64)
        own = rng.integers(0, 2**63, (2, int(n * (1 - share) / (2 * share))), dtype=np.uint64)
        sets = [np.unique(np.concatenate([common, o])) for o in own]
        _, sketches = near_dedup.sign(np.concatenate(sets), np.array([len(s) for s in sets]))
        apart = int(np.bitwise_count(sketches[0] ^ sketches[1]).sum())
        assert abs(near_dedup.estimate(apart) - share) < 0.13
        assert share < 0.79 or apart <= near_dedup.most_differing()


def test_sketches_lose_no_pair_at_the_least_linked_similarity():
    # 8 of 10 shingles in common; with NEAR = 0.65 seven of these pairs were too far apart
    sets = np.random.default_rng(7).integers(0, 2**64, (30_000, 10), dtype=np.uint64)
    signed = [near_dedup.sign(np.ascontiguousarray(s).ravel(), np.full(len(s), 9)) for s in (sets[:, :9], sets[:, 1:])]
    apart = np.bitwise_count(signed[0][1] ^ signed[1][1]).sum(axis=1, dtype=int)
    assert apart.max() <= near_dedup.most_differing()
    assert (signed[0][0] == signed[1][0]).any(axis=1).all()


def test_components_of_a_path_a_ring_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 100 + (i + 1) % 9) for i in range(9)] + [(200, 200 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(9)} | {200 + i: 200 for i in range(30)}


def lines_left(docs):
    """What stays of each document: lines without words, and lines that no earlier line equals or resembles."""
    seen, out = [], {}
    for i, text in sorted(docs):
        left = []
        for line in text.split("\n"):
            s = frozenset(words(line))
            if not s or not any(5 * len(s & t) >= 4 * len(s | t) for t in seen):
                left.append(line)
            if s:
                seen.append(s)
        out[i] = "\n".join(left)
    return out


def test_op5_keeps_the_first_of_similar_lines(spark, documents):
    got = queries.op5_line_dedup(spark, SF).toPandas().set_index("doc_id")
    want = lines_left(zip(documents.doc_id, documents.text, strict=True))
    assert got.text.to_dict() == want
    assert (got.n_lines == documents.set_index("doc_id").text.str.count("\n") + 1).loc[got.index].all()


@pytest.mark.parametrize("crowd", [512, 4])
def test_crowded_words(spark, monkeypatch, crowd):
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    monkeypatch.setattr(line_dedup, "NEAREST", 2)
    rng = random.Random(8)
    base = [f"rare{i}" for i in range(12)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(3):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(12)] = f"other{rng.randrange(30)}"
            lines.append(" ".join(w))
        docs.append((i, "\n".join(lines)))
    got = line_dedup.remove_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.text for r in got} == lines_left(docs)


def test_line_dedup_of_odd_rows(spark, odd_docs, no_docs):
    got = {(r.doc_id, r.text is None): (r.n_lines, r.n_removed) for r in line_dedup.remove_lines(odd_docs).collect()}
    assert got[1, False] == (1, 0) and got[7, False] == (1, 1)  # rows equal in id and text stay together
    assert got[3, True] == (0, 0) and got[2, False] == (1, 0) and got[2**62, False][1] == 0
    assert line_dedup.remove_lines(no_docs).collect() == []


def test_lines_and_words_are_those_of_plain_splitting():
    parts = ["a", "B", "é", " ", "\n", "\t", "\r", "\x0b", "z" * 9, "日本語", "x" * 70, "\0", "q" * 8, "w" * 64]
    rng = random.Random(2)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(500)]
    texts = ["", None, *texts, "", " ", "\n", "a"]
    per_text, rows, codes, hashes = line_dedup._lines(pa.array(texts)[1:])
    lines = [line for t in texts[1:] for line in (t or "").split("\n")]
    assert per_text.tolist() == [(t or "").count("\n") + 1 for t in texts[1:]]
    want = [(i, w) for i, line in enumerate(lines) for w in words(line)]
    assert rows.tolist() == [i for i, _ in want]
    number = {}
    assert codes.tolist() == [number.setdefault(w, len(number)) for _, w in want]
    assert len(set(hashes.tolist())) == len(number)


def _sorted_postings(n, words_of):
    names = [c.split()[0] for c in line_dedup._POSTING.split(", ")]
    ones = np.ones(n, np.int64)
    x = dict.fromkeys(names, ones) | {"word": words_of, "class": np.arange(n), "doc": np.arange(n), "size": 9 * ones, "bits1": 0 * ones, "bits2": 0 * ones}
    return [pa.RecordBatch.from_pydict({k: v[i : i + 500] for k, v in x.items()}) for i in range(0, n, 500)]


def test_small_batches_of_postings_are_paired_up_together():
    batches = _sorted_postings(20_000, np.arange(20_000) // 2)
    got = list(line_dedup._pairs(0, 8, True)(iter(batches)))
    assert len(got) == 1  # one a batch takes a round of all steps for every 500 postings
    assert sorted(zip(got[0]["later"].to_pylist(), got[0]["earlier"].to_pylist())) == [(2 * i + 1, 2 * i) for i in range(10_000)]


def test_postings_in_many_parts_give_all_pairs(monkeypatch):
    batches = _sorted_postings(6000, np.repeat(np.arange(9), [1, 3, 1200, 2, 700, 1, 90, 4000, 3]))
    pairs = lambda got: sorted((a, b) for g in got for a, b in zip(g["later"].to_pylist(), g["earlier"].to_pylist()) if a is not None)
    whole = pairs(line_dedup._pairs(0, 8, True)(iter(batches)))
    monkeypatch.setattr(line_dedup, "TOGETHER", 600)
    monkeypatch.setattr(line_dedup, "AT_ONCE", 10)
    assert pairs(line_dedup._pairs(0, 8, True)(iter(batches))) == whole and len(whole) > 40_000


def test_pairs_of_a_large_group_leave_in_parts():
    batches = _sorted_postings(1500, np.zeros(1500, np.int64))
    wanted = [b.append_column("wanted", pa.array(np.ones(len(b), bool))) for b in batches]
    got = list(line_dedup._pairs(0, 4096, False)(iter(wanted)))
    assert max(len(b) for b in got) <= 1 << 14  # all pairs of the group at once took a worker's memory
    pairs = {(a, b) for g in got for a, b in zip(g["later"].to_pylist(), g["earlier"].to_pylist())}
    assert pairs == {(a, b) for a in range(1500) for b in range(a)}


def test_counts_of_cells_travel_in_few_rows():
    total = np.random.default_rng(4).integers(0, 3, line_dedup.CELLS)
    blocks, packed = line_dedup._packed(total)
    assert len(blocks) == line_dedup.CELLS // line_dedup.BLOCK
    again = total.copy()
    line_dedup._unpacked(pa.array(blocks), pa.array(packed, pa.binary()), again)
    assert (again == 2 * total).all()


def test_filter_never_says_no_wrongly():
    numbers = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 3000)
    f = line_dedup.Filter(6000)
    f.add(numbers)
    assert f.has(numbers).all() and f.has(numbers + 1).mean() < 0.2
    assert len(f.bits) == 6000
