"""Ranked lexical search over segments of an inverted index, with bounds of term pairs.

Index: documents are taken in segments of a bounded number of bytes, each inverted in
its task: per term the documents that hold it and how often.  Nothing is shuffled but the
number of documents of each term.  A segment is a row group of its own and goes to Python
by itself, so a task holds one at a time, however many its partition has.

Lists: for a block of queries, the postings of their terms get their impact (what a
posting adds to a score, without the term's weight), and every ``STRETCH`` documents of a
segment the greatest impact of each term.  Terms of a query stand in order of weight; for
every two neighbours their postings are intersected, and every stretch in which they meet
gets the greatest impact of both together.

Search: terms are added up from the heaviest on.  What the terms still to come can add to
a document of a stretch is bounded by a chain over them, in which each term counts for
itself or two neighbours count together: what they reach where they meet, or the greater
one of them.  That is never more than the sum of the terms' maxima, and far less where
heavy terms don't meet.  Postings of documents that cannot reach the k-th best score any
more are left out, and once no new document can, terms are only looked up for the
documents that are left.  The k-th best score is carried on from segment to segment.

The results are exact: bounds leave out only what cannot be among the best ``k``.

Rows are documents, whatever their ids: rows of one id are ranked each, a null id comes
before all others among equal scores.  A null or empty text has no terms and counts in no
statistic.  Each row of the queries is a query of its own; one without terms, or whose
terms no document holds, has no results.  Texts of any length are cut between words while
they are counted.
"""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import arrow_rows, pick, running_starts, ship, stage

#: A segment is closed at so many bytes of text.
SEGMENT_BYTES = 8 << 20
#: ... or documents.
SEGMENT_DOCS = 1 << 15
#: Documents that go to Python at once.
BATCH_DOCS = 500
#: Each row, a segment or its lists, is a row group: readers and writers hold one of them.
ALONE = {"parquet.block.row.count.limit": 1}
#: Documents that share a bound.
STRETCH = 256
#: Terms of one block of queries, in bytes; a block is held by the driver and by every task.
BLOCK_BYTES = 1 << 20
#: Bytes of a text that are split at a time.
SLICE = 1 << 20
#: Best rows of so many tasks meet in one group before all meet.
FAN = 64

_SEPARATORS = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_LETTERS = bytes(32 if b in _SEPARATORS else b + 32 if 65 <= b <= 90 else b for b in range(256))


def term_counts(text: bytes | None) -> Counter:
    """How often each term stands in a UTF-8 text: ASCII letters in lower case, digits, all beyond ASCII."""
    counts: Counter = Counter()
    if not text:
        return counts
    plain = text.translate(_LETTERS)
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + SLICE) if len(plain) - at > SLICE else -1
        end = len(plain) if end < 0 else end
        counts.update(plain[at:end].split())
        at = end
    return counts


def _texts(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


INDEX = (
    "segment long, ids binary, known binary, sizes binary, terms array<binary>, df array<int>, "
    "docs binary, tfs binary, n_docs long, n_terms long"
)


class _Segment:
    """Documents gathered so far and their terms, numbered as they come."""

    def __init__(self):
        self.bytes = 0
        self.ids, self.known, self.sizes, self.distinct = [], [], [], []
        self.codes, self.tfs = array("i"), array("i")
        self.terms: defaultdict = defaultdict()
        self.terms.default_factory = self.terms.__len__

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        counts = term_counts(text)
        if counts:  # others are no part of any statistic or result
            self.bytes += len(text)
            self.ids.append(doc_id or 0)
            self.known.append(doc_id is not None)
            self.sizes.append(counts.total())
            self.distinct.append(len(counts))
            self.codes.extend(map(self.terms.__getitem__, counts))
            self.tfs.extend(counts.values())

    def row(self, number: int) -> list:
        codes, tfs = np.frombuffer(self.codes, np.int32), np.frombuffer(self.tfs, np.int32)
        docs = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.distinct)
        names = np.array([*self.terms, None], object)[:-1]
        by_name = np.array(sorted(range(len(names)), key=names.__getitem__), np.int32)
        place = np.empty(len(names), np.int32)
        place[by_name] = np.arange(len(names), dtype=np.int32)
        order = np.argsort(place[codes], kind="stable")
        sizes = np.array(self.sizes, np.int64)
        return [
            number,
            np.array(self.ids, np.int64).tobytes(),
            np.array(self.known, bool).tobytes(),
            sizes.tobytes(),
            list(names[by_name]),
            np.bincount(place[codes], minlength=len(names)).astype(np.int32).tolist(),
            docs[order].tobytes(),
            tfs[order].tobytes(),
            len(self.ids),
            int(sizes.sum()),
        ]


@dataclass
class Index:
    """Segments, the number of documents of each term, and the counts that scores need."""

    segments: DataFrame
    lexicon: DataFrame
    n_docs: int
    n_terms: int


def build(docs: DataFrame) -> Index:
    """The index of ``docs`` (doc_id, text; other columns are ignored)."""
    ship(docs.sparkSession)
    schema = pa.schema(
        [
            ("segment", pa.int64()), ("ids", pa.binary()), ("known", pa.binary()), ("sizes", pa.binary()),
            ("terms", pa.list_(pa.binary())), ("df", pa.list_(pa.int32())), ("docs", pa.binary()),
            ("tfs", pa.binary()), ("n_docs", pa.int64()), ("n_terms", pa.int64()),
        ]
    )

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        done, now = 0, _Segment()

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, now.row(first + done), strict=True))], schema)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), _texts(batch, "text"), strict=True):
                now.add(doc_id, text)
                if now.bytes >= SEGMENT_BYTES or len(now.ids) >= SEGMENT_DOCS:
                    yield closed()
                    done, now = done + 1, _Segment()
        if now.ids:
            yield closed()

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with arrow_rows(docs.sparkSession, BATCH_DOCS):
        segments = stage(rows.mapInArrow(invert, INDEX), "segments", **ALONE)
    total = segments.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    each = segments.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).select("t.terms", "t.df")
    lexicon = each.groupBy(F.col("terms").alias("term")).agg(F.sum("df").alias("df"))
    return Index(segments, stage(lexicon, "lexicon"), total[0] or 0, total[1] or 0)


def plan_queries(index: Index, queries: DataFrame) -> DataFrame:
    """One row a query: query (a number), item_id, its terms from the heaviest to the lightest, weights, block.

    Terms that no document holds, or that weigh nothing, are left out.
    """
    schema = pa.schema([("query", pa.int64()), ("term", pa.binary())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, text in zip(batch.column("query").to_pylist(), _texts(batch, "text"), strict=True):
                terms = list(term_counts(text))
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(terms), pa.int64()), pa.array(terms, pa.binary())], schema=schema)

    numbered = pick(queries, "item_id", "text").withColumn("query", F.monotonically_increasing_id())
    numbered = stage(numbered, "queries")
    terms = numbered.select("query", "text").mapInArrow(split, "query long, term binary")
    known = terms.join(index.lexicon, "term")
    weight = F.floor(1000 * F.log((2.0 * index.n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weighed = known.withColumn("weight", weight).where("weight > 0")
    heavy_first = F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("minus"), "term")))
    plans = weighed.groupBy("query").agg(heavy_first.alias("t"))
    plans = plans.select(
        "query", F.col("t.term").alias("terms"), F.transform("t.minus", lambda w: -w).alias("weights"),
        F.aggregate("t.term", F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t) + 16).alias("size"),
    )
    plans = running_starts(stage(plans, "plans"), "query", "size", "start")
    plans = plans.join(numbered.select("query", "item_id"), "query")
    return stage(plans.select("query", "item_id", "terms", "weights", F.floor(F.col("start") / BLOCK_BYTES).alias("block")), "plans")


@dataclass
class Workload:
    """Queries of one block: terms by number, with weights, and neighbours in the order of weight."""

    terms: list[bytes]
    weights: np.ndarray
    queries: list[tuple[int, np.ndarray]]
    pairs: list[tuple[int, int]]
    pair_of: dict[tuple[int, int], int]

    @staticmethod
    def of(rows: list) -> Workload:
        numbers: dict[bytes, int] = {}
        weights, queries, pair_of = [], [], {}
        for r in rows:
            own = []
            for term, weight in zip(r["terms"], r["weights"], strict=True):
                term = bytes(term)
                if term not in numbers:
                    numbers[term] = len(numbers)
                    weights.append(weight)
                own.append(numbers[term])
            for pair in zip(own, own[1:], strict=False):
                pair_of.setdefault(pair, len(pair_of))
            queries.append((r["query"], np.array(own, np.int64)))
        return Workload(list(numbers), np.array(weights, np.int64), queries, list(pair_of), pair_of)


LISTS = (
    "segment long, ids binary, known binary, n_docs long, starts binary, docs binary, impacts binary, "
    "peaks binary, pair_starts binary, pair_stretches binary, pair_peaks binary"
)


def _lists_of(segment: dict, load: Workload, n_docs: int, n_terms: int) -> dict:
    """Impact lists of the workload's terms and pairs in one segment."""
    sizes = np.frombuffer(segment["sizes"], np.int64)
    ends = np.cumsum(np.array(segment["df"], np.int64))
    at = {t: i for i, t in enumerate(segment["terms"])}
    docs, tfs = np.frombuffer(segment["docs"], np.int32), np.frombuffer(segment["tfs"], np.int32)
    length = 50 + (50 * sizes * n_docs) // n_terms
    stretches = -(-len(sizes) // STRETCH)
    peaks = np.zeros((len(load.terms), stretches), np.int64)
    own_docs, own_impacts = [], []
    for i, term in enumerate(load.terms):
        k = at.get(term)
        if k is None:
            own_docs.append(docs[:0])
            own_impacts.append(tfs[:0])
            continue
        lo, hi = int(ends[k - 1]) if k else 0, int(ends[k])
        d, tf = docs[lo:hi], tfs[lo:hi].astype(np.int64)
        impact = (1_000_000_000 * tf) // (1000 * tf + 20 * length[d])
        np.maximum.at(peaks[i], d // STRETCH, impact)
        own_docs.append(d)
        own_impacts.append(impact)
    met, pair_stretches, pair_peaks = [], [], []
    for a, b in load.pairs:
        both, x, y = np.intersect1d(own_docs[a], own_docs[b], assume_unique=True, return_indices=True)
        stretch = both // STRETCH
        first = np.flatnonzero(np.r_[True, stretch[1:] != stretch[:-1]]) if len(both) else both
        met.append(len(first))
        if len(first):
            joint = load.weights[a] * own_impacts[a][x] + load.weights[b] * own_impacts[b][y]
            pair_stretches.append(stretch[first])
            pair_peaks.append(np.maximum.reduceat(joint, first))
    starts = np.cumsum([0, *map(len, own_docs)])
    join = lambda parts, kind: (np.concatenate(parts) if parts else np.zeros(0)).astype(kind).tobytes()
    return {
        "segment": segment["segment"], "ids": segment["ids"], "known": segment["known"], "n_docs": len(sizes),
        "starts": join([starts], np.int64), "docs": join(own_docs, np.int32), "impacts": join(own_impacts, np.int32),
        "peaks": peaks.tobytes(), "pair_starts": join([np.cumsum([0, *met])], np.int64),
        "pair_stretches": join(pair_stretches, np.int32), "pair_peaks": join(pair_peaks, np.int64),
    }


class SegmentLists:
    """One segment's impact lists, read back."""

    def __init__(self, row: dict, load: Workload):
        self.load = load
        self.n_docs = row["n_docs"]
        self.ids, self.known = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool)
        self.starts = np.frombuffer(row["starts"], np.int64)
        self.docs, self.impacts = np.frombuffer(row["docs"], np.int32), np.frombuffer(row["impacts"], np.int32)
        self.stretches = -(-self.n_docs // STRETCH)
        self.peaks = np.frombuffer(row["peaks"], np.int64).reshape(-1, self.stretches)
        self.pair_starts = np.frombuffer(row["pair_starts"], np.int64)
        self.pair_stretches = np.frombuffer(row["pair_stretches"], np.int32)
        self.pair_peaks = np.frombuffer(row["pair_peaks"], np.int64)

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        cut = slice(self.starts[term], self.starts[term + 1])
        return self.docs[cut], self.impacts[cut]

    def together(self, a: int, b: int, alone: np.ndarray) -> np.ndarray:
        """Most that terms a and b add to one document of each stretch; ``alone`` is the greater of them."""
        out = alone.copy()
        n = self.load.pair_of[(a, b)]
        cut = slice(self.pair_starts[n], self.pair_starts[n + 1])
        where = self.pair_stretches[cut]
        out[where] = np.maximum(out[where], self.pair_peaks[cut])
        return out

    def bounds(self, terms: np.ndarray, pairs: bool = True) -> np.ndarray:
        """Most that the terms from each one on can add, per stretch; the last row is 0."""
        peaks = self.peaks[terms] * self.load.weights[terms][:, None]
        left = np.zeros((len(terms) + 1, self.stretches), np.int64)
        for j in range(len(terms) - 1, -1, -1):
            left[j] = peaks[j] + left[j + 1]
            if pairs and j + 1 < len(terms):
                both = self.together(int(terms[j]), int(terms[j + 1]), np.maximum(peaks[j], peaks[j + 1]))
                np.minimum(left[j], both + left[j + 2], out=left[j])
        return left


def best_of_segment(lists: SegmentLists, terms: np.ndarray, k: int, least: int, pairs: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents (places in the segment) with a score of ``least`` or more that may be among the best k.

    Returns their places, their scores, and how many postings were added up.
    """
    left = lists.bounds(terms, pairs)
    scores = np.zeros(lists.n_docs, np.int64)
    stretch = np.arange(lists.n_docs) // STRETCH
    least = max(least, 1)
    added, live = 0, None
    for j, term in enumerate(terms):
        weight = int(lists.load.weights[term])
        docs, impacts = lists.postings(int(term))
        if live is None and not (left[j] >= least).any():
            live = np.flatnonzero((scores > 0) & (scores + left[j][stretch] >= least))
        if live is not None:
            live = live[scores[live] + left[j][stretch[live]] >= least]
            at = np.minimum(np.searchsorted(docs, live), max(len(docs) - 1, 0))
            hit = docs[at] == live if len(docs) else np.zeros(len(live), bool)
            scores[live[hit]] += weight * impacts[at[hit]].astype(np.int64)
            added += int(hit.sum())
            continue
        use = scores[docs] + left[j][docs // STRETCH] >= least
        docs, impacts = docs[use], impacts[use]
        scores[docs] += weight * impacts.astype(np.int64)
        added += len(docs)
        if lists.n_docs > k:
            least = max(least, int(np.partition(scores, lists.n_docs - k)[lists.n_docs - k]))
    found = np.flatnonzero(scores >= least)
    return found, scores[found], added


def _best(ids: np.ndarray, known: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the best k: highest score, then a null id, then the least id."""
    return np.lexsort((ids, known, -scores))[:k]


def search(docs_index: Index, queries: DataFrame, k: int) -> DataFrame:
    """The best ``k`` documents of every row of ``queries`` (item_id, text): query, item_id, rank, doc_id, score.

    Queries are taken in blocks of a bounded size; each block passes over the index once.
    """
    spark = queries.sparkSession
    ship(spark)
    n_docs, n_terms = docs_index.n_docs, docs_index.n_terms
    plans = plan_queries(docs_index, queries)
    blocks = plans.agg(F.max("block")).first()[0]
    out = spark.createDataFrame([], "query long, doc_id long, score long, task int")
    for block in range(0 if blocks is None else blocks + 1):
        load = Workload.of(plans.where(F.col("block") == block).collect())
        if not load.queries:
            continue
        held = spark.sparkContext.broadcast(load)

        def weigh(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for segment in _rows(batch):
                    yield pa.RecordBatch.from_pylist([_lists_of(segment, held.value, n_docs, n_terms)])

        def rank(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            load = held.value
            best = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * len(load.queries)
            for batch in batches:
                for row in _rows(batch):
                    lists = SegmentLists(row, load)
                    for q, (_, terms) in enumerate(load.queries):
                        ids, known, scores = best[q]
                        least = int(scores[-1]) if len(scores) == k else 0
                        found, new, _ = best_of_segment(lists, terms, k, least)
                        ids, known, scores = np.r_[ids, lists.ids[found]], np.r_[known, lists.known[found]], np.r_[scores, new]
                        keep = _best(ids, known, scores, k)
                        best[q] = ids[keep], known[keep], scores[keep]
            for (number, _), (ids, known, scores) in zip(load.queries, best, strict=True):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ids), number, np.int64)),
                        pa.array(ids, mask=~known),
                        pa.array(scores),
                        pa.array(np.full(len(ids), TaskContext.get().partitionId(), np.int32)),
                    ],
                    ["query", "doc_id", "score", "task"],
                )

        with arrow_rows(spark, 1):
            lists = stage(docs_index.segments.drop("n_terms").mapInArrow(weigh, LISTS), "lists", **ALONE)
            out = out.unionAll(stage(lists.mapInArrow(rank, "query long, doc_id long, score long, task int"), "found"))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    groups = out.withColumn("group", F.floor(F.col("task") / FAN))
    some = groups.withColumn("rank", F.row_number().over(Window.partitionBy("query", "group").orderBy(*order)))
    ranked = some.where(F.col("rank") <= k).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).join(plans.select("query", "item_id"), "query").select("query", "item_id", "rank", "doc_id", "score")
