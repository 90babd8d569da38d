"""Merkle manifest against trees built in plain Python."""

import hashlib
import zlib

import pytest
from compare import database, differences
from orderlens.llm import merkle, queries
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def grow(nodes):
    """Levels from the leaves to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + 2]) for i in range(0, len(last), 2)])
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        other = at ^ 1
        known = level[other] if other < len(level) else ""
        out.append((known, "") if at % 2 else ("", known))
        at //= 2
    return out


def plain(rows):
    """(group, order, leaf, carried) -> sorted rows of (carried, leaf, subroot, root, proof)."""
    order = lambda v: (v is not None, v)
    groups = {}
    for r in sorted(rows, key=lambda r: (order(r[0]), order(r[1]), r[2])):
        groups.setdefault(r[0], []).append(r)
    trees = [grow([r[2] for r in g]) for g in groups.values()]
    top = grow([t[-1][0] for t in trees])
    out = []
    for i, (g, tree) in enumerate(zip(groups.values(), trees, strict=True)):
        for k, r in enumerate(g):
            out.append((r[3], r[2], tree[-1][0], top[-1][0], siblings(tree, k) + siblings(top, i)))
    return sorted(out, key=str)


def built(df):
    found = merkle.manifest(df, merkle.leaf(F.col("id"), F.col("text")), "lang", "id", {"id": F.col("id")})
    found = found.withColumn("folded", merkle.fold(F.col("leaf"), F.col("proof"))).collect()
    assert all(r.folded == r.root for r in found)
    rows = [(r.id, r.leaf, r.subroot, r.root, [(s.before, s.after) for s in r.proof]) for r in found]
    return sorted(rows, key=str)


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_trees_of_all_shapes(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", levels)
    sizes = {"a": 1, "b": 2, None: 3, "c": 5, "d": 16, "é": 17, "": 4, "z": 33 if levels > 1 else 9}
    rows = [(i * 7 % 101, f"text {lang} {i}", lang) for lang, n in sizes.items() for i in range(n)]
    rows += [(None, None, "b"), (None, "x", None), (3, "again", "d"), (3, "again", "d"), (3, "other", "d")]
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    assert built(df) == plain([(lang, i, leaf(i, t), i) for i, t, lang in rows])


def test_a_changed_row_gives_another_root(spark):
    df = spark.createDataFrame([(i, f"t{i}", "en") for i in range(20)], "id long, text string, lang string")
    found = merkle.manifest(df, merkle.leaf(F.col("id"), F.col("text")), "lang", "id", {"id": F.col("id")})
    wrong = merkle.leaf(F.col("id"), F.lit("something else"))
    rows = found.select(merkle.fold(wrong, F.col("proof")).alias("folded"), "root").collect()
    assert all(r.folded != r.root for r in rows)


def test_no_rows_have_no_root(spark, no_docs):
    found = merkle.manifest(no_docs, merkle.leaf(F.col("doc_id")), "lang", "doc_id", {"doc_id": F.col("doc_id")})
    assert found.collect() == []


def test_op11_with_nulls_and_other_columns(spark, tmp_path):
    rows = [(1, "s", None, 3, "abc", "x"), (None, None, None, None, None, None), (7, "s", "en", None, "", "y"), (7, "s", "en", None, "", "y")]
    rows += [(i, "ß", "en", i, "long " * i * 100, "z") for i in range(20, 60)]
    schema = "doc_id long, source string, lang string, n_chars long, text string, digest string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_merkle_manifest(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    want = plain([(r[2], r[0], leaf(r[0], r[1], r[2], r[3], r[4]), r[0]) for r in rows])
    proofs = sorted(((r[0], r[1], r[2], r[3], h(*(b + a for b, a in r[4]))) for r in want), key=str)
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in got), key=str) == proofs
    for r in got:
        hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
        n_chars = next(x[3] for x in rows if x[0] == r.doc_id)
        assert r.verified == (not hit or n_chars is None)


def test_op11_equals_its_twin(spark):
    want = database(SF).sql(queries.ORACLES["op11_merkle_manifest"]).to_arrow_table()
    assert differences(queries.op11_merkle_manifest(spark, SF).toArrow(), want) == []
