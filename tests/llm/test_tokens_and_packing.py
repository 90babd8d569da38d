"""Token shards and packing against plain encoding of whole texts."""

import random
import re
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from orderlens.llm import packing, queries, tokens, wavelet
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.01"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def plain(path, texts):
    t = Tokenizer.from_file(path)
    return [e.ids for e in t.encode_batch(list(texts), add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_chunks_give_the_ids_of_whole_texts(path, documents):
    assert tokens.ChunkEncoder(path).pieces is not None
    alphabet = [" "] * 6 + list("\n1-AZéÀßªºµ×÷'") + list("ab'd \n\t.1é́Σσ\xa0\x1c<|> \x85")
    rng = random.Random(3)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["", " ", "  a", "don't  '' 's<|endoftext|> x", "Σας ΟΔΟΣ", "x \n", *documents.text[:100]]
    ids, counts = tokens.ChunkEncoder(path).encode(texts)
    ends = np.cumsum(counts)
    got = [ids[e - c : e].tolist() for c, e in zip(counts, ends, strict=True)]
    assert got == plain(path, texts)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_names_of_added_tokens_are_their_ids_as_by_default(path):
    names = [t.content for t in Tokenizer.from_file(path).get_added_tokens_decoder().values()]
    parts = [*names, names[0].upper(), "<|", "endoftext", " ", "  ", "\n", "a", "Wort", " b", "1", ".", "é", "\xa0"]
    rng = random.Random(11)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(4000)]
    texts += [f"ab {n} cd" for n in names] + names
    ids, counts = tokens.ChunkEncoder(path).encode(texts)
    ends = np.cumsum(counts)
    assert [ids[e - c : e].tolist() for c, e in zip(counts, ends, strict=True)] == plain(path, texts)


@pytest.mark.parametrize("words", [False, True])
def test_plain_pieces_are_those_of_the_patterns(words):
    alphabet = list("abAZzéÀßÿ079.,-'_" + "  \n")
    rng = random.Random(5)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts = ["x", "", *(t for t in texts if not re.search(tokens._ODD.replace(r"\z", r"\Z").replace(tokens._RUN, r"\s\s"), t)), ""]
    pieces, counts = tokens.plain_pieces(pa.array(texts, pa.large_string())[1:], words)
    found = [(tokens._WORD_PIECES if words else tokens._BYTE_PIECES).findall(t) for t in texts[1:]]
    assert counts.tolist() == [len(f) for f in found] and len(texts) > 300
    assert pieces.to_pylist() == [p for f in found for p in f]


def test_memory_forgets(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 3)
    enc = tokens.ChunkEncoder(BYTE)
    for text in ("a b c d e", "e d f a", "g h", "", "a b Ünïcode +1 e", "a"):
        assert enc.encode([text])[0].tolist() == plain(BYTE, [text])[0]


@pytest.mark.parametrize("path", [BYTE, WORD])
@pytest.mark.parametrize("sign", ["", "—"])
def test_words_are_looked_up_together(path, sign):
    """No Python function is called for each word, neither for new ones nor for known ones."""
    enc, rng = tokens.ChunkEncoder(path), random.Random(4)
    words = ["".join(rng.choice("abcdeéß") for _ in range(9)) for _ in range(4000)]
    texts = [" ".join(words[i : i + 100]) + sign for i in range(0, len(words), 100)]
    wanted = [i for ids in plain(path, texts) for i in ids]
    for _ in range(2):
        calls = []
        sys.setprofile(lambda _, event, __: calls.append(event) if event == "call" else None)
        try:
            ids, _ = enc.encode(texts)
        finally:
            sys.setprofile(None)
        assert ids.tolist() == wanted and len(calls) < 1000


def test_memory_finds_what_is_old_and_names_what_is_new(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 1)
    memory = tokens.Memory()
    memory.young |= {"a": b"1", "b": b"2"}
    memory.trim()
    memory.young["c"] = b"3"
    assert memory.find(["d", "b", "c", "e"]) == ([None, b"2", b"3", None], [0, 3])
    assert memory.young == {"c": b"3", "b": b"2"}
    assert memory.find([]) == ([], [])


def test_op3_against_plain_encoding(spark, documents):
    got = queries.op3_wavelet_shards(spark, SF).toPandas().sort_values("doc_id", ignore_index=True)
    ids = [[*x, 0] for x in plain(BYTE, documents.text)]
    n = [len(x) for x in ids]
    assert got.doc_id.tolist() == documents.doc_id.tolist()
    assert got.n_tokens.tolist() == n
    assert got.start.tolist() == (np.cumsum(n) - n).tolist()
    assert got.ids_crc32.tolist() == [crc(x) for x in ids]


def test_many_shards_and_odd_rows(spark, odd_docs, no_docs):
    rows = wavelet.round_trip(odd_docs, BYTE, shard_bytes=2000).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, -4, 1, 1, 2, 3, 5, 6, 7, 2**62]
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows[:-1])]).tolist()
    by_id = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rows}
    assert by_id[2] == by_id[3] == [0]
    assert by_id[-4] == [*plain(BYTE, ["don't stop"])[0], 0]
    assert wavelet.round_trip(no_docs, BYTE).collect() == []


@pytest.mark.parametrize("top", [1, 2, 3, 50_000, 70_000])
def test_wavelet_matrix(top):
    rng = np.random.default_rng(top)
    ids = rng.integers(0, top, 2111, dtype=np.uint32)
    shard = wavelet.Shard(wavelet.to_file(ids, [5, None], np.array([2000, 111])))
    assert shard.all().tolist() == ids.tolist()
    assert shard.doc_ids == [5, None] and shard.lengths.tolist() == [2000, 111]
    for at in [0, 1, 7, 8, 511, 512, 513, 2110, *rng.integers(0, 2111, 40).tolist()]:
        assert shard.access(at) == ids[at]
    for token in {*ids[:12].tolist(), 0, top, 2**20}:
        where = np.flatnonzero(ids == token)
        assert shard.count(token) == len(where)
        assert shard.count(token, 700) == (where < 700).sum()
        for k in range(0, len(where), max(1, len(where) // 5)):
            assert shard.locate(token, k) == where[k]
        with pytest.raises(IndexError):
            shard.locate(token, len(where))


@pytest.mark.parametrize("top", [2, 50_000, 70_000])
def test_planes_longer_than_a_block_are_undone(top):
    ids = np.random.default_rng(top).integers(0, top, 2 * wavelet._BLOCK + 77, dtype=np.uint32)
    for part in (ids, ids[: wavelet._BLOCK], np.sort(ids)):
        planes, _ = wavelet.build(part)
        back = wavelet.restore(planes, len(part))
        assert back.dtype == np.uint32 and (back == part).all()


def test_wavelet_file_of_nothing_and_broken_file():
    empty = wavelet.Shard(wavelet.to_file(np.zeros(0, np.uint32), [], np.zeros(0)))
    assert empty.all().tolist() == [] and empty.count(3) == 0
    with pytest.raises(ValueError):
        wavelet.Shard(wavelet.to_file(np.arange(9), [1], np.array([9]))[:-2])


def _check_packing(rows, texts, length):
    """Each id in one piece, windows gapless and never too long; returns the padding's share."""
    ids = {k: [*v, 2] for k, v in zip(texts, plain(WORD, [t or "" for t in texts.values()]), strict=True)}
    seen, used = {}, {}
    for r in sorted(rows, key=lambda r: (str(r.doc_id), r.start)):
        own = ids[r.doc_id]
        assert r.start == seen.get(r.doc_id, 0) and r.doc_tokens == len(own) and r.length > 0
        assert np.frombuffer(r.ids, "<u4").tolist() == own[r.start : r.start + r.length]
        seen[r.doc_id] = r.start + r.length
    assert seen == {k: len(v) for k, v in ids.items()}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= length
    return 1 - sum(used.values()) / (length * len(used))


@pytest.mark.parametrize(("length", "most", "parts"), [(4096, 64, 1), (4096, 8, 3), (64, 2, 4)])
def test_packing_is_whole_and_tight(spark, documents, length, most, parts):
    docs = spark.createDataFrame(documents[["doc_id", "text"]]).repartition(parts)
    rows = packing.pack(docs, WORD, 2, length, most).collect()
    texts = dict(zip(documents.doc_id, documents.text, strict=True))
    assert _check_packing(rows, texts, length) < (0.02 if length == 4096 else 0.25)


def test_packing_of_odd_rows(spark, odd_docs, no_docs):
    once = odd_docs.dropDuplicates(["doc_id"]).repartition(2)
    rows = packing.pack(once, WORD, 2, 32, 3).collect()
    texts = {r[0]: r[1] for r in once.collect()}
    _check_packing(rows, texts, 32)
    assert packing.pack(no_docs, WORD, 2).collect() == []
    twice = packing.pack(odd_docs, WORD, 2).where("doc_id = 1").collect()
    assert sum(r.length for r in twice) == 2 * twice[0].doc_tokens


def test_packer_takes_the_best_fit_and_closes_the_fullest():
    p = packing.Packer(10, 2)
    assert [p.place(6), p.place(7), p.place(3), p.place(4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    assert p.open == {}
    assert [p.place(8), p.place(9), p.place(5)] == [(2, 0), (3, 0), (4, 0)]
    assert p.open == {2: 8, 4: 5}


def test_op9_digest(spark):
    rows = queries.op9_bounded_packing(spark, SF).collect()
    first = [r for r in rows if r.doc_tokens == r.length][:50]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert [r.ids_crc32 for r in first] == [crc([*x, 2]) for x in plain(WORD, [docs[r.doc_id] for r in first])]
