"""Near-duplicates by MinHash bands and odd sketches.

1. Every text becomes a set of word shingles.  Texts with the same set are one class.
2. MinHash samples of each class are cut into bands; classes that agree in a band share
   a bucket.  All samples are also folded into an odd sketch: a bitmap whose bits say
   whether an odd number of samples fell on them.  The bits in which two sketches
   differ estimate how many samples differ, precisely where similarity is high.
3. Sketches are compared within buckets, in blocks where a bucket is large; a pair that
   shares several buckets belongs to the first of them.  Classes with a near partner
   go on, once per bucket, with their full sets.
4. Full sets are compared in the bucket's task, and pairs that links found there have
   already connected are left out.  So no pair leaves a task but the links of a tree,
   and a group of copies costs about one comparison a class.

Two classes at the least linked similarity of 0.8 share no bucket in one of 2 * 10^7
cases (32 bands of 4), and have sketches too far apart in one of 4 * 10^7; at 0.85 both
happen less than a hundredth as often.  Sets whose sizes differ by more than a fifth
can't be linked and aren't compared.

Bad input: null, empty and white texts have no shingles and are linked with nothing;
fewer words than a shingle make one shingle; a null id is no candidate for the
component's id, unless all are null; repeated rows are one class; other columns are
ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import pick, scratch, ship, stage
from orderlens.llm.components import connected
from orderlens.llm.membership import filter_of
from orderlens.llm.shingles import mix, per_row, shingle_sets
from orderlens.llm.tokens import text_slices

BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
#: Sketches count as near from this estimate on: links at the least similarity are lost less often than by the bands.
NEAR = 0.55
#: Classes of a bucket in one block; two blocks meet in one task.
BLOCK = 1024

_LOW = -(2**63)
_FACTORS = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64)) | np.uint64(1)
_SALTS = mix(np.arange(1001, 1001 + SAMPLES, dtype=np.uint64))


def most_differing(bits: int = SKETCH_BITS, samples: int = SAMPLES, similarity: float = NEAR) -> int:
    """Differing bits expected at a similarity: 2 (1 - s) samples differ, each flips one bit."""
    return int(bits / 2 * (1 - (1 - 2 / bits) ** (2 * (1 - similarity) * samples)))


def estimate(differing: np.ndarray, bits: int = SKETCH_BITS, samples: int = SAMPLES) -> np.ndarray:
    """Similarity from the number of differing bits."""
    return 1 + bits / (4 * samples) * np.log(np.maximum(1 - 2 * np.asarray(differing) / bits, 1e-9))


def sign(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (texts x BANDS) and odd sketches (texts x bytes) of texts with shingles."""
    least = np.empty((len(counts), SAMPLES), np.uint64)
    starts = np.cumsum(counts) - counts
    for i in range(SAMPLES):
        least[:, i] = np.minimum.reduceat(hashes * _FACTORS[i], starts)
    keys = np.full((len(counts), BANDS), 0, np.uint64) + mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for r in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + least[:, r::ROWS])
    at = (mix(least + _SALTS) % np.uint64(SKETCH_BITS)).astype(np.int64)
    flat = np.bincount((np.arange(len(counts))[:, None] * SKETCH_BITS + at).ravel(), minlength=len(counts) * SKETCH_BITS)
    return keys, np.packbits((flat & 1).astype(np.uint8).reshape(len(counts), SKETCH_BITS), axis=1)


def _nodes(hashes: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """128 bits that name each set."""
    one = per_row(mix(hashes), counts, np.add)
    two = per_row(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), counts, np.add)
    raw = np.stack([one, two], axis=1).astype(">u8").tobytes()
    return [raw[i : i + 16] for i in range(0, len(raw), 16)]


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _signed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole)):
            hashes, counts = shingle_sets(batch.column("text"), size)
            full = counts > 0
            keys, sketches = (
                sign(hashes, counts[full]) if full.any() else (np.zeros((0, BANDS), np.uint64), np.zeros((0, SKETCH_BITS // 8), np.uint8))
            )
            places = np.cumsum(full) - 1
            nodes = _nodes(hashes, counts)
            take = pa.array(np.where(full, places, 0), mask=~full)
            lists = pa.ListArray.from_arrays(
                np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.view(np.int64).ravel(), pa.int64())
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([n if f else None for n, f in zip(nodes, full.tolist(), strict=True)], pa.binary()),
                    pa.array(counts, pa.int64()),
                    lists.take(take),
                    _binary(sketches).take(take),
                ],
                ["doc_id", "node", "n_shingles", "bands", "sketch"],
            )

    return run


def _sets(size: int, sent_ids):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = (whole.filter(pa.array(sent_ids.value.has(_ids(whole)))) for whole in batches)
        for batch in (part for whole in wanted for part in text_slices(whole)):
            hashes, counts = shingle_sets(batch.column("text"), size)
            ends = np.cumsum(counts).tolist()
            sets = [hashes[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            nodes = _nodes(hashes, counts)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())], ["node", "hashes"])

    return run


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return pc.fill_null(batch.column("doc_id"), _LOW).to_numpy(zero_copy_only=False)


_CELL = "key long, i int, j int, block int, node binary, n long, bands array<long>, sketch binary"


def _cells(classes: DataFrame) -> DataFrame:
    """Rows of all buckets of several classes; every two blocks of a bucket meet in one cell (key, i, j)."""
    members = classes.select("node", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    shared = shared.select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    rows = members.join(shared, "key").join(classes.select("node", "n", "bands", "sketch"), "node")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = [F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")]
    return rows.select("key", *cell, "block", "node", "n", "bands", "sketch")


def _by_cell(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Table]]:
    """Cells of sorted rows, those that end within each batch together."""
    left: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([left, rows]) if left is not None else rows
        change = np.zeros(len(rows), bool)
        for c in ("key", "i", "j"):
            column = rows.column(c).to_numpy()
            change[1:] |= column[1:] != column[:-1]
        borders = [0, *np.flatnonzero(change).tolist()]
        yield [rows.slice(x, y - x) for x, y in zip(borders[:-1], borders[1:], strict=True)]
        left = rows.slice(borders[-1]).combine_chunks()
    if left is not None:
        yield [left]


def _near_in_cell(cell: pa.Table, limit: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows near by sketch and size that share no earlier bucket."""
    none = np.zeros(0, np.int64)
    if len(cell) < 2:
        return none, none
    i, j, key = (cell.column(c)[0].as_py() for c in ("i", "j", "key"))
    block, size = cell.column("block").to_numpy(), cell.column("n").to_numpy()
    sketches = np.frombuffer(b"".join(cell.column("sketch").to_pylist()), np.uint64).reshape(len(cell), -1)
    bands = cell.column("bands").combine_chunks().flatten().to_numpy().reshape(len(cell), -1)
    band = int(np.flatnonzero(bands[0] == key)[0])
    first = np.flatnonzero(block == i)
    second = first if i == j else np.flatnonzero(block == j)
    lefts, rights = [none], [none]
    for a in first.tolist():
        others = second[second > a] if i == j else second
        fit = 100 * np.minimum(size[others], size[a]) >= percent * np.maximum(size[others], size[a])
        others = others[fit]
        apart = np.bitwise_count(sketches[a] ^ sketches[others]).sum(axis=1, dtype=np.int32)
        others = others[apart <= limit]
        if band and len(others):
            others = others[~(bands[others, :band] == bands[a, :band]).any(axis=1)]
        lefts.append(np.full(len(others), a))
        rights.append(others)
    return np.concatenate(lefts), np.concatenate(rights)


def _candidates(percent: int):
    """Rows of the cells that have a near partner there."""
    limit = most_differing()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cells in _whole_cells(batches):
            kept = []
            for cell in cells:
                left, right = _near_in_cell(cell, limit, percent)
                if len(left):
                    kept.append(cell.take(pa.array(np.union1d(left, right))))
            if kept:
                yield from pa.concat_tables(kept).combine_chunks().to_batches()

    return run


def _links_in_cell(cell: pa.Table, limit: int, percent: int) -> list[tuple[bytes, bytes]]:
    """Links between rows by full sets, a tree for each group of linked rows."""
    left, right = _near_in_cell(cell, limit, percent)
    if not len(left):
        return []
    nodes = cell.column("node").to_pylist()
    sets = [np.frombuffer(x, np.uint64) for x in cell.column("hashes").to_pylist()]
    size = np.array([len(x) for x in sets])
    starts = np.cumsum(size) - size
    names, ids = np.unique(np.concatenate(sets), return_inverse=True)
    marked = np.zeros(len(names), bool)
    root = np.arange(len(nodes))
    out = []
    borders = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]]))
    for x, y in zip(borders.tolist(), [*borders[1:].tolist(), len(left)], strict=True):
        a, others = int(left[x]), right[x:y]
        others = others[root[others] != root[a]]
        if not len(others):
            continue
        own = ids[starts[a] : starts[a] + size[a]]
        marked[own] = True
        n = size[others]
        upto = np.cumsum(n)
        at = np.arange(upto[-1]) + np.repeat(starts[others] - (upto - n), n)
        common = np.add.reduceat(marked[ids[at]].astype(np.int64), upto - n)
        marked[own] = False
        for b in others[100 * common >= percent * (size[a] + n - common)].tolist():
            if root[a] != root[b]:
                out.append((nodes[a], nodes[b]))
                root[root == root[b]] = root[a]
    return out


def _links(percent: int):
    limit = most_differing()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cells in _whole_cells(batches):
            pairs = [p for cell in cells for p in _links_in_cell(cell, limit, percent)]
            a, b = zip(*pairs, strict=True) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return run


def cluster(docs: DataFrame, size: int, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least id reachable), node (its class).

    Documents are linked where 100 * common >= percent * all shingles of both.
    """
    ship(docs.sparkSession)
    with scratch(docs.sparkSession):
        return stage(_clusters(pick(docs, "doc_id", "text"), size, percent), "clusters", result=True)


def _clusters(docs: DataFrame, size: int, percent: int) -> DataFrame:
    signed = stage(docs.mapInArrow(_signed(size), "doc_id long, node binary, n_shingles long, bands array<long>, sketch binary"), "signed")
    full = signed.where("node is not null")
    # rows of a class differ in their ids only
    classes = full.groupBy("node").agg(
        F.min("doc_id").alias("doc_id"),
        F.first("n_shingles").alias("n"),
        F.first("bands").alias("bands"),
        F.first("sketch").alias("sketch"),
    )
    classes = stage(classes, "classes")
    near = stage(_by_cell(_cells(classes)).mapInArrow(_candidates(percent), _CELL), "near")
    sets = _needed_sets(docs, classes, near.select("node").distinct(), size)
    links = _by_cell(near.join(sets, "node")).mapInArrow(_links(percent), "a binary, b binary")
    roots = connected(links)
    labels = classes.select("node", "doc_id").join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    least = labels.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    labels = labels.join(least, "root").select("node", "component_id")
    return signed.join(labels, "node", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "node",
    )


def _needed_sets(docs: DataFrame, classes: DataFrame, needed: DataFrame, size: int) -> DataFrame:
    """Full sets of the classes that pairs name, from the text of one document each; and a few more.

    A filter of the documents' ids goes to the texts, so no text is shuffled.
    """
    ids = classes.join(needed, "node").select(F.coalesce("doc_id", F.lit(_LOW)).alias("doc_id")).distinct()
    sent = docs.sparkSession.sparkContext.broadcast(filter_of(stage(ids, "needed")))  # FILTER_BYTES at most
    sets = docs.mapInArrow(_sets(size, sent), "node binary, hashes binary")
    return stage(sets.dropDuplicates(["node"]), "sets")
