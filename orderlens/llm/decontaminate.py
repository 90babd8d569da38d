"""Benchmark decontamination by Wu-Manber search for many strings at once.

Texts become bytes in which words are separated by one space.  Windows of benchmark
words are the search strings.  A table over hashed blocks of eight bytes says how far
the search may jump; where it says nothing, the block may end the first bytes of some
strings, a bucket names them, and the bytes are compared.  Many documents are searched
abreast, each from its own place, so that every step is one array operation.

Search strings are made by Spark, and taken in blocks of a bounded number of bytes; every
block passes over the numbered documents once, and what the blocks found is merged.  A long
item, or a string of many items, may lie in several blocks.

Bad input: a null text has no words; an empty benchmark hits nothing; repeated ids are
searched row by row; items with the same id count once; windows of items without an id are
searched and hit like any other, and ``nameless`` says where one occurs; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import pick, running_starts, ship, stage
from orderlens.llm.tokens import text_slices

#: Words of a window.
WINDOW = 13
#: Bytes of search strings that one pass over the documents may carry.
BLOCK_BYTES = 2 * 1024 * 1024
#: Texts up to this size share one array.
GROUP_BYTES = 16 * 1024 * 1024

#: Each text is searched from one place in so many bytes.
STRETCH = 4096

_HASH_BITS = 22
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SPACE = 32


def _byte_table() -> np.ndarray:
    """Words are runs of a-z, 0-9 and bytes from 128; A-Z in lower case, all else a space."""
    t = np.full(256, _SPACE, np.uint8)
    for first, last in ((ord("0"), ord("9")), (ord("a"), ord("z")), (128, 255)):
        t[first : last + 1] = np.arange(first, last + 1)
    t[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    return t


_TABLE = _byte_table()


def clean_bytes(raw: np.ndarray) -> np.ndarray:
    """Words with one space before, between and after them; an empty array without words."""
    t = _TABLE[raw]
    space = t == _SPACE
    keep = ~space
    keep[1:] |= ~space[:-1]
    if len(space):
        keep[0] = not space[0]
    t = t[keep]
    if not len(t):
        return t
    tail = [] if t[-1] == _SPACE else [_SPACE]
    return np.concatenate([np.array([_SPACE], np.uint8), t, np.array(tail, np.uint8)])


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    """Search strings of one item: each window between spaces, or all of a shorter item."""
    words = clean_bytes(np.frombuffer((text or "").encode(), np.uint8)).tobytes().split()
    if not words:
        return []
    return [b" %b " % b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


class Searcher:
    """Shift table and suffix buckets over strings of at least ``width`` bytes."""

    def __init__(self, strings: list[bytes], width: int):
        self.strings = strings
        self.width = width
        least = min(min(map(len, strings)), 128)
        self.reach = least - width
        heads = np.frombuffer(b"".join(s[:least] for s in strings) + bytes(8), np.uint8)
        self.shift = np.full(1 << _HASH_BITS, self.reach + 1, np.uint8)
        first = np.arange(len(strings)) * least
        for end in range(self.reach + 1):  # the later a block lies, the smaller the jump
            self.shift[self._blocks(heads, first + end)] = self.reach - end
        suffix = self._blocks(heads, first + self.reach)
        self.members = np.argsort(suffix, kind="stable")
        self.suffixes = suffix[self.members]

    def _blocks(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hashes of the blocks that begin at these places; eight bytes must follow each."""
        eight = np.ndarray(len(data) - 7, np.uint64, data, strides=(1,))[at]
        if self.width < 8:
            eight = eight & np.uint64((1 << 8 * self.width) - 1)
        return (eight * _MULTIPLIER) >> np.uint64(64 - _HASH_BITS)

    def find(self, data: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
        """Pairs (place, string number) of all occurrences within the texts from starts to ends.

        Texts begin and end with a space and strings have no two spaces in a row, so
        nothing is found across two texts.
        """
        counts = -(-(ends - starts) // STRETCH)
        begins = np.repeat(starts, counts)
        begins += (np.arange(len(begins)) - np.repeat(np.cumsum(counts) - counts, counts)) * STRETCH
        last = np.repeat(ends, counts)
        at = begins + self.reach
        stop = np.minimum(begins + STRETCH - 1 + self.reach, last - self.width)
        while True:
            live = at <= stop
            if not live.all():
                at, stop = at[live], stop[live]
            if not len(at):
                return
            block = self._blocks(data, at)
            jump = self.shift[block]
            here = np.flatnonzero(jump == 0)
            if len(here):
                low = np.searchsorted(self.suffixes, block[here], side="left")
                high = np.searchsorted(self.suffixes, block[here], side="right")
                for begin, a, b in zip((at[here] - self.reach).tolist(), low.tolist(), high.tolist(), strict=True):
                    for k in self.members[a:b].tolist():
                        if raw.startswith(self.strings[k], begin):
                            yield begin, k
            at = at + np.maximum(jump, 1)


#: Strings are searched by length class, so that a short one doesn't shorten the jumps for all: least length, block width.
_CLASSES = ((3, 3), (8, 4), (16, 8), (32, 8), (56, 8))


class Matcher:
    """A block of search strings, each with an item it stands in."""

    def __init__(self, strings: list[tuple[bytes, str | None]]):
        owners: dict[bytes, set[str | None]] = {}
        for string, item in strings:
            owners.setdefault(bytes(string), set()).add(item)
        self.owners = owners
        classes: dict[int, list[bytes]] = {}
        for s in owners:
            classes.setdefault(sum(len(s) >= least for least, _ in _CLASSES), []).append(s)
        self.searchers = [Searcher(v, _CLASSES[k - 1][1]) for k, v in sorted(classes.items())]

    def find(
        self, given: np.ndarray, offsets: np.ndarray
    ) -> tuple[np.ndarray, list[tuple[set[int], set[str]] | None]]:
        """Words of each text, and for the texts with occurrences (else None) the hit words and the items."""
        texts = [clean_bytes(given[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        ends = np.cumsum([len(t) for t in texts])
        starts = ends - np.array([len(t) for t in texts], np.int64)
        data = np.concatenate([*texts, np.zeros(8, np.uint8)])
        raw = data.tobytes()
        upto = np.concatenate([[0], np.cumsum(data == _SPACE)])
        n_words = np.maximum(upto[ends] - upto[starts] - 1, 0)
        marks: dict[int, tuple[set[int], set[str]]] = {}
        for searcher in self.searchers:
            for begin, k in searcher.find(data, raw, starts, ends):
                doc = int(np.searchsorted(ends, begin, side="right"))
                hit, items = marks.setdefault(doc, (set(), set()))
                first = int(upto[begin] - upto[starts[doc]])
                hit.update(range(first, first + searcher.strings[k].count(b" ") - 1))
                items |= self.owners[searcher.strings[k]]
        return n_words, [marks.get(i) for i in range(len(texts))]


_SCHEMA = "row long, doc_id long, n_words long, hit_words array<long>, item_ids array<string>, nameless boolean"


def _one_block(rows: DataFrame, strings: list[tuple[bytes, str | None]]) -> DataFrame:
    """Every row with what the strings of one block hit in it."""
    sent = rows.sparkSession.sparkContext.broadcast(strings)  # near BLOCK_BYTES

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value)
        for batch in batches:
            for group in text_slices(batch, "raw", GROUP_BYTES):
                column = group.column("raw").cast(pa.large_binary())
                raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
                offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
                n_words, marks = matcher.find(raw, offsets)
                names = [m[1] if m else set() for m in marks]
                yield pa.RecordBatch.from_arrays(
                    [
                        group.column("row"),
                        group.column("doc_id"),
                        pa.array(n_words, pa.int64()),
                        pa.array([sorted(m[0]) if m else [] for m in marks], pa.list_(pa.int64())),
                        pa.array([sorted(n - {None}) for n in names], pa.list_(pa.string())),
                        pa.array([None in n for n in names], pa.bool_()),
                    ],
                    [c.split()[0] for c in _SCHEMA.split(", ")],
                )

    raw = rows.select("row", "doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw"))
    return raw.mapInArrow(search, _SCHEMA)


def search_strings(benchmark: DataFrame, size: int = WINDOW, block_bytes: int | None = None) -> DataFrame:
    """(string, item, block): the distinct windows of all items, in blocks of near ``block_bytes``."""
    items = pick(benchmark, "item_id", "text").select(F.col("item_id").cast("string").alias("item"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = windows(text, size)
                for at in range(0, len(found), 4096):
                    part = found[at : at + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([item] * len(part), pa.string())], ["string", "item"])

    strings = items.mapInArrow(cut, "string binary, item string").distinct()
    bytes_ = F.octet_length("string") + F.coalesce(F.octet_length("item"), F.lit(0)) + 64
    strings = strings.withColumns({"size": bytes_.cast("long"), "order": F.monotonically_increasing_id()})
    placed = running_starts(stage(strings, "strings"), "order", "size", "start")
    return stage(placed.select("string", "item", F.floor(F.col("start") / (block_bytes or BLOCK_BYTES)).alias("block")), "blocks")


def search(rows: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per row what all blocks hit: row, doc_id, n_words, hit_words, item_ids, nameless.

    ``rows`` (row, doc_id, text) has a number of its own in every row and is read from
    files, so that every block sees the same numbers.
    """
    ship(rows.sparkSession)
    strings = search_strings(benchmark, size)
    last = strings.agg(F.max("block")).first()[0] or 0
    found = []
    for block in range(last + 1):
        own = strings.where(F.col("block") == block).select("string", "item").collect()
        found.append(stage(_one_block(rows, [(r["string"], r["item"]) for r in own]), "hits"))
    merged = reduce(DataFrame.unionAll, found).groupBy("row")
    return merged.agg(
        F.first("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("hit_words")))).alias("hit_words"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        F.bool_or("nameless").alias("nameless"),
    )


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per document its words, the numbers of words inside occurrences, and the items found.

    Returns doc_id, n_words, hit_words (from 0, ascending), item_ids (sorted), and nameless:
    whether an item without an id was found.
    """
    numbered = pick(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    return search(stage(numbered, "rows"), benchmark, size).drop("row")


def is_contaminated(n_words, n_hit):
    """Hit words make a twentieth of the text at least."""
    return (n_hit > 0) & (20 * n_hit >= n_words)
