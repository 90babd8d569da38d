"""Sequence packing in bounded space.

Each partition keeps a fixed number of open windows.  A document's full windows are
cut off and leave at once; what remains goes whole into the open window that it fills
best.  If it fits none, the fullest window is closed and a new one opened.  The
windows still open at the end of the partitions are merged: laid end to end and cut
again at every full window, by running sums, so no task sees them all.

Bad input: a null or empty text is a document of its end id only; repeated rows are
packed each; a null id stays null; other columns are ignored; no rows give no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import pick, running_starts, ship, stage
from orderlens.llm.tokens import encoder, text_slices

LENGTH = 4096
#: Windows a partition keeps open.
OPEN = 64

_PIECES = "doc_id long, start long, length long, doc_tokens long, window long, offset long, left boolean, ids binary"


class Packer:
    """Open windows of one partition; a window is its number and the tokens in it."""

    def __init__(self, length: int = LENGTH, most: int = OPEN):
        self.length, self.most = length, most
        self.open: dict[int, int] = {}
        self.made = 0

    def new(self) -> int:
        self.made += 1
        return self.made - 1

    def place(self, size: int) -> tuple[int, int]:
        """Window and offset for a piece of less than a window."""
        best, least = -1, self.length + 1
        for w, used in self.open.items():  # the oldest of equally good ones
            free = self.length - used
            if size <= free < least:
                best, least = w, free
        if best < 0:
            if len(self.open) == self.most:
                del self.open[max(self.open, key=lambda w: (self.open[w], -w))]
            best = self.new()
            self.open[best] = 0
        at = self.open[best]
        self.open[best] = at + size
        if at + size == self.length:
            del self.open[best]
        return best, at


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH, most: int = OPEN) -> DataFrame:
    """Pieces of all documents and their places.

    Returns doc_id, start (ids of the document before the piece), length, ids
    (little-endian, 32 bits), doc_tokens, sequence_id, offset.
    """
    ship(docs.sparkSession)
    docs = pick(docs, "doc_id", "text")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer).encode, Packer(length, most)
        base = TaskContext.get().partitionId() << 32
        still: list[tuple] = []
        for batch in (part for whole in batches for part in text_slices(whole)):
            flat, counts = encode(batch.column("text"))
            upto = np.concatenate([[0], np.cumsum(counts)])
            out: list[tuple] = []
            for doc, a, n in zip(batch.column("doc_id").to_pylist(), upto[:-1].tolist(), (counts + 1).tolist(), strict=True):
                ids = np.append(flat[a : a + n - 1], np.uint32(end_id)).astype("<u4")
                for start in range(0, n, length):
                    size = min(length, n - start)
                    window, at = (packer.new(), 0) if size == length else packer.place(size)
                    row = (doc, start, size, n, window, at, ids[start : start + size].tobytes())
                    (out if size == length else still).append(row)
            # pieces wait until their window is closed
            out += [r for r in still if r[4] not in packer.open]
            still = [r for r in still if r[4] in packer.open]
            yield _batch(out, base, False)
        yield _batch(still, base, True)

    placed = stage(docs.mapInArrow(pieces, _PIECES), "pieces")
    return _merged(placed, length)


def _batch(rows: list[tuple], base: int, left: bool) -> pa.RecordBatch:
    doc, start, size, n, window, at, ids = zip(*rows, strict=True) if rows else ((),) * 7
    number = lambda x: pa.array(x, pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            number(doc),
            number(start),
            number(size),
            number(n),
            number([base + w for w in window]),
            number(at),
            pa.array([left] * len(rows), pa.bool_()),
            pa.array(ids, pa.binary()),
        ],
        ["doc_id", "start", "length", "doc_tokens", "window", "offset", "left", "ids"],
    )


def _merged(placed: DataFrame, length: int) -> DataFrame:
    """Lay the windows left open end to end and cut them anew."""
    keep = ["doc_id", "start", "length", "ids", "doc_tokens"]
    closed = placed.where("not left").select(*keep, F.col("window").alias("sequence_id"), "offset")
    left = placed.where("left")
    windows = left.groupBy("window").agg(F.sum("length").alias("used"))
    part = F.shiftright("window", 32)
    parts = running_starts(windows.groupBy(part.alias("part")).agg(F.sum("used").alias("used")), "part", "used", "first")
    inside = Window.partitionBy("part").orderBy("window").rowsBetween(Window.unboundedPreceding, -1)  # OPEN rows
    begins = windows.withColumn("part", part).join(parts.select("part", "first"), "part")
    begins = begins.select("window", (F.col("first") + F.coalesce(F.sum("used").over(inside), F.lit(0))).alias("begin"))
    at = F.col("begin") + F.col("offset")
    moved = left.join(begins, "window").withColumn("at", at)
    size = F.lit(length)
    # a piece is shorter than a window, so it falls into one new window or two
    room = size - F.col("at") % size
    both = F.when(room < F.col("length"), F.array(F.lit(0), room)).otherwise(F.array(F.lit(0).cast("long")))
    cut = moved.withColumn("room", room).withColumn("skip", F.explode(both))
    length_ = F.when(F.col("skip") > 0, F.col("length") - F.col("room")).otherwise(F.least("length", "room"))
    merged = cut.select(
        "doc_id",
        (F.col("start") + F.col("skip")).alias("start"),
        length_.alias("length"),
        F.substring("ids", (F.col("skip") * 4 + 1).cast("int"), (length_ * 4).cast("int")).alias("ids"),
        "doc_tokens",
        (-1 - F.floor((F.col("at") + F.col("skip")) / size)).cast("long").alias("sequence_id"),
        ((F.col("at") + F.col("skip")) % size).alias("offset"),
    )
    return closed.unionByName(merged)
