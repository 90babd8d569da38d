"""Token shards as wavelet matrices: succinct bit planes with rank and select.

A shard holds the ids of consecutive documents.  Its matrix keeps one plane per bit,
highest bit first; below each plane the ids whose bit is 0 come first, in order, then
those whose bit is 1.  Counting ones (rank) leads a place down through the planes to
its id, finding the k-th one (select) leads an id back up to its k-th place.  One
compressed file per shard holds planes and document lengths; the counts that rank
needs are rebuilt when a file is opened.

File: magic, then five little-endian 64-bit numbers (tokens, planes, documents, null
flags' bytes, packed bytes), then one zstandard frame of the planes, plane after plane
(eight bits a byte, first bit highest, each plane padded to a byte), the documents'
lengths and ids as 64-bit integers, and one null flag a document.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.llm.common import fresh_path, running_starts, ship
from orderlens.llm.ranges import by_id
from orderlens.llm.tokens import encoder, text_slices

#: Bytes of text in a shard, nearly; one task handles one shard at a time.
SHARD_BYTES = 8 * 1024 * 1024

_MAGIC = b"WVMX0001"
_HEAD = struct.Struct("<8s5q")
_STEP = 64  # bytes between two counts of the rank directory
_BLOCK = 32 * 1024  # ids put back at a time
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def build(ids: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
    """Packed planes of the matrix, highest bit first, and the zeros in each."""
    ids = np.asarray(ids, np.uint32)
    width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    if width <= 16:
        ids = ids.astype(np.uint16)
    planes, zeros = [], []
    for bit in range(width - 1, -1, -1):
        ones = ((ids >> ids.dtype.type(bit)) & ids.dtype.type(1)).astype(np.uint8).view(bool)
        planes.append(np.packbits(ones))
        up = np.compress(ones, ids)
        ids = np.concatenate([np.compress(~ones, ids), up])
        zeros.append(len(ids) - len(up))
    return planes, zeros


def restore(planes: list[np.ndarray], n: int) -> np.ndarray:
    """All ids in order: the planes undone from the lowest up."""
    kind = np.uint16 if len(planes) <= 16 else np.uint32
    ids, above = np.zeros(n, kind), np.empty(n, kind)
    for bit, plane in enumerate(reversed(planes)):
        ones = np.unpackbits(plane, count=n).view(bool)
        low, high = 0, n - int(np.count_nonzero(ones))
        ids[high:] |= kind(1 << bit)
        for first in range(0, n, _BLOCK):  # places of a block stay in the processor's cache
            part, up = above[first : first + _BLOCK], ones[first : first + _BLOCK]
            at = up.nonzero()[0]
            part[at] = ids[high : high + len(at)]
            high += len(at)
            at = (~up).nonzero()[0]
            part[at] = ids[low : low + len(at)]
            low += len(at)
        ids, above = above, ids
    return ids.astype(np.uint32)


def to_file(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """One shard as the bytes of its file."""
    planes, _ = build(ids)
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    body = b"".join(
        [
            *(p.tobytes() for p in planes),
            np.asarray(lengths, "<i8").tobytes(),
            np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
            nulls.tobytes(),
        ]
    )
    packed = zstandard.ZstdCompressor(level=1).compress(body)
    return _HEAD.pack(_MAGIC, len(ids), len(planes), len(doc_ids), len(nulls), len(packed)) + packed


class Shard:
    """A shard read from its file."""

    def __init__(self, content: bytes):
        magic, self.n, width, docs, flags, size = _HEAD.unpack_from(content)
        if magic != _MAGIC or len(content) != _HEAD.size + size:
            raise ValueError("not a whole shard file")
        body = zstandard.ZstdDecompressor().decompress(content[_HEAD.size :])
        row = -(-self.n // 8)
        self.planes = [np.frombuffer(body, np.uint8, row, k * row) for k in range(width)]
        self.lengths = np.frombuffer(body, "<i8", docs, width * row)
        ids = np.frombuffer(body, "<i8", docs, width * row + 8 * docs).tolist()
        null = np.frombuffer(body, np.uint8, flags, width * row + 16 * docs)
        self.doc_ids = [None if x else d for d, x in zip(ids, null, strict=True)]
        self._ranks: list[np.ndarray] | None = None

    def all(self) -> np.ndarray:
        return restore(self.planes, self.n)

    def _directory(self) -> list[np.ndarray]:
        if self._ranks is None:
            self._ranks = []
            for p in self.planes:
                ones = _ONES[p]
                padded = np.concatenate([ones, np.zeros(-len(ones) % _STEP, np.uint8)])
                sums = padded.reshape(-1, _STEP).sum(axis=1, dtype=np.int64)
                self._ranks.append(np.concatenate([[0], np.cumsum(sums)]))
            self.zeros = [self.n - int(r[-1]) for r in self._ranks]
        return self._ranks

    def _bit(self, k: int, at: int) -> int:
        return int(self.planes[k][at >> 3]) >> (7 - (at & 7)) & 1

    def rank(self, k: int, at: int) -> int:
        """Ones in plane k before place ``at``."""
        block = (at >> 3) // _STEP
        p, total = self.planes[k], int(self._directory()[k][block])
        total += int(_ONES[p[block * _STEP : at >> 3]].sum())
        return total + (int(_ONES[p[at >> 3] >> (8 - (at & 7))]) if at & 7 else 0)

    def select(self, k: int, bit: int, nth: int) -> int:
        """Place of the nth (from 0) one, or zero, of plane k."""
        low, high = 0, self.n
        while low < high:
            middle = (low + high) // 2
            ones = self.rank(k, middle + 1)
            if (ones if bit else middle + 1 - ones) > nth:
                high = middle
            else:
                low = middle + 1
        return low

    def access(self, at: int) -> int:
        """Id at a place of the shard."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        self._directory()
        out = 0
        for k in range(len(self.planes)):
            bit = self._bit(k, at)
            ones = self.rank(k, at)
            at = self.zeros[k] + ones if bit else at - ones
            out = out << 1 | bit
        return out

    def _range(self, token: int, upto: int) -> tuple[int, int]:
        """Bottom range of the occurrences of a token before a place."""
        self._directory()
        low, high, width = 0, upto, len(self.planes)
        if token < 0 or token >> width:
            return 0, 0
        for k in range(width):
            a, b = self.rank(k, low), self.rank(k, high)
            if token >> (width - 1 - k) & 1:
                low, high = self.zeros[k] + a, self.zeros[k] + b
            else:
                low, high = low - a, high - b
        return low, high

    def count(self, token: int, upto: int | None = None) -> int:
        """Occurrences of a token before a place, or in all."""
        low, high = self._range(token, self.n if upto is None else upto)
        return high - low

    def locate(self, token: int, nth: int) -> int:
        """Place of the nth (from 0) occurrence of a token."""
        low, high = self._range(token, self.n)
        if not 0 <= nth < high - low:
            raise IndexError(nth)
        at, width = low + nth, len(self.planes)
        for k in range(width - 1, -1, -1):
            bit = token >> (width - 1 - k) & 1
            at = self.select(k, bit, at - self.zeros[k] if bit else at)
        return at


_FILES = "piece int, n_docs long, n_tokens long, content binary"


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, shard_bytes: int = SHARD_BYTES) -> None:
    """Tokenise whole texts and write one file per shard, in ascending order of doc_id.

    A null text counts as empty, so the document has its end id only.  A null id
    comes first; rows of one id are ordered by text.  Other columns are ignored.
    An empty table gives an empty folder of shards.
    """
    dealt, _ = by_id(docs, shard_bytes)

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        piece, ids, doc_ids, lengths = 0, [], [], []
        for batch in (part for whole in batches for part in text_slices(whole)):
            piece = batch.column("piece")[0].as_py()
            flat, counts = encode(batch.column("text"))
            out = np.full(len(flat) + len(counts), end_id, np.uint32)
            keep = np.ones(len(out), bool)
            keep[np.cumsum(counts + 1) - 1] = False
            out[keep] = flat
            ids.append(out)
            doc_ids += batch.column("doc_id").to_pylist()
            lengths.append(counts + 1)
        if ids:  # one partition is one shard
            n = sum(map(len, ids))
            content = to_file(np.concatenate(ids), doc_ids, np.concatenate(lengths))
            yield pa.RecordBatch.from_pylist(
                [{"piece": piece, "n_docs": len(doc_ids), "n_tokens": n, "content": content}],
                pa.schema([("piece", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("content", pa.binary())]),
            )

    shards = dealt.mapInArrow(files, _FILES)
    shards.write.option("compression", "uncompressed").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Documents read back: doc_id, start (tokens of all documents before it), n_tokens, ids (little-endian, 32 bits)."""
    ship(spark)
    files = spark.read.schema(_FILES).parquet(path)
    starts = running_starts(files.select("piece", "n_tokens"), "piece", "n_tokens", "first").select("piece", "first")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                shard = Shard(batch.column("content")[i].as_py())
                first = batch.column("first")[i].as_py()
                ids = shard.all().astype("<u4")
                upto = np.concatenate([[0], np.cumsum(shard.lengths)])
                offsets = pa.py_buffer((upto * 4).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.doc_ids, pa.int64()),
                        pa.array(first + upto[:-1], pa.int64()),
                        pa.array(shard.lengths, pa.int64()),
                        pa.Array.from_buffers(pa.binary(), len(shard.lengths), [None, offsets, pa.py_buffer(ids.tobytes())]),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return files.select("piece", "content").join(starts, "piece").mapInArrow(
        rows, "doc_id long, start long, n_tokens long, ids binary"
    )


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the shards to the shared folder and read the documents back from them."""
    path = fresh_path(docs.sparkSession, "token-shards")
    write_shards(docs, path, tokenizer, end_id, shard_bytes)
    return read_shards(docs.sparkSession, path)


