"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; any training text may stand among the
unlabelled ones.  A linear model over words and their first and last letters is
fitted by the class-prior-corrected risk: the loss of the positives as positives,
plus the loss of the unlabelled as negatives less the part that positives add to it,
which is not let below zero.  The driver fits on a bounded sample; every text is scored.

Bad input: a null or empty text has no words and gets the model's score for no
evidence; without confirmed examples every score is 0; a null id is held out;
repeated rows are scored each; labels that repeat an id count once, toxic if any says
so; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.llm.common import pick, ship
from orderlens.llm.tokens import text_slices

#: Bounds of the training sample: texts, and bytes of one text.
POSITIVES, UNLABELLED, SAMPLE_BYTES = 2500, 7500, 40_000
#: Features kept, those that tell positives from unlabelled texts best.
FEATURES = 500
STEPS, RATE, DECAY = 400, 0.05, 1e-4

_BITS = 22


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def word_features(word: str) -> list[int]:
    """Hashed features of a word: itself, its first four letters, its last four."""
    mask = (1 << _BITS) - 1
    return [zlib.crc32(x.encode()) & mask for x in ("=" + word, "^" + word[:4], word[-4:] + "$")]


def _words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, and per text (first array) the numbers of its words (second)."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), r"[^\pL]+", " ")
    lists = pc.split_pattern(plain, " ")
    rows = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), rows, coded.indices.to_numpy(zero_copy_only=False)


def features(texts: pa.Array, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (text number, feature), sorted; with ``known`` only those features."""
    words, rows, codes = _words(texts)
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    per_word = np.array([word_features(w) for w in words], np.int64)
    per_word[[i for i, w in enumerate(words) if not w]] = -1
    if known is not None:
        per_word[~np.isin(per_word, known)] = -1
        live = (per_word >= 0).any(axis=1)[codes]
        rows, codes = rows[live], codes[live]
    pairs = (np.repeat(rows, 3) << _BITS) | np.maximum(per_word[codes].ravel(), 0)
    pairs = np.unique(pairs[per_word[codes].ravel() >= 0])
    return pairs >> _BITS, pairs & ((1 << _BITS) - 1)


@dataclass
class Model:
    """Weights of the known features, and the score's base."""

    known: np.ndarray
    weights: np.ndarray
    base: float
    empty: bool = False

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.empty:
            return np.zeros(len(texts))
        rows, found = features(texts, self.known)
        logit = self.base + np.bincount(rows, self.weights[np.searchsorted(self.known, found)], len(texts))
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _csr(lists: list[np.ndarray], known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    flat = np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64)
    at = np.minimum(np.searchsorted(known, flat), max(len(known) - 1, 0))
    here = known[at] == flat if len(known) else np.zeros(len(flat), bool)
    return rows[here], at[here]


def fit(positives: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """Minimise the non-negative risk over features of positive and unlabelled texts."""
    if not positives or not unlabelled:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0, empty=True)
    n_p, n_u = len(positives), len(unlabelled)
    names, counts_p = np.unique(np.concatenate(positives), return_counts=True)
    more, counts_u = np.unique(np.concatenate(unlabelled), return_counts=True)
    every = np.union1d(names, more)
    p, u = np.zeros(len(every)), np.zeros(len(every))
    p[np.searchsorted(every, names)], u[np.searchsorted(every, more)] = counts_p, counts_u
    both = (p + u) / (n_p + n_u)
    z = (p / n_p - u / n_u) / np.sqrt(both * (1 - both) * (1 / n_p + 1 / n_u) + 1e-9)
    known = np.sort(every[np.argsort(-np.abs(z), kind="stable")[:FEATURES]])
    (rows_p, at_p), (rows_u, at_u) = _csr(positives, known), _csr(unlabelled, known)
    w, base = np.zeros(len(known)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(known) + 1), np.zeros(len(known) + 1)
    for step in range(1, STEPS + 1):
        g_p = base + np.bincount(rows_p, w[at_p], n_p)
        g_u = base + np.bincount(rows_u, w[at_u], n_u)
        s_p, s_u = 1 / (1 + np.exp(-np.clip(g_p, -30, 30))), 1 / (1 + np.exp(-np.clip(g_u, -30, 30)))
        as_negative = np.logaddexp(0, g_u).mean() - prior * np.logaddexp(0, g_p).mean()
        if as_negative >= 0:  # d of: prior * loss of p as positive + loss of u as negative - prior * loss of p as negative
            d_p, d_u = np.full(n_p, -prior / n_p), s_u / n_u
        else:  # the estimate below zero is not a risk: step back from it
            d_p, d_u = prior * s_p / n_p, -s_u / n_u
        slope = np.append(
            np.bincount(at_p, d_p[rows_p], len(known)) + np.bincount(at_u, d_u[rows_u], len(known)) + DECAY * w,
            d_p.sum() + d_u.sum(),
        )
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, base = w - move[:-1], base - move[-1]
    return Model(known, w, base)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on rows that are not held out."""
    docs = pick(docs, "doc_id", "text").where(~held_out(F.col("doc_id")))
    labels = pick(labels, "doc_id", "toxic").where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = labels.agg(F.avg("toxic").alias("p")).first()["p"]
    if not share:
        return fit([], [], 0.5)
    order = F.xxhash64("doc_id")
    short = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES)
    # ids are chosen first, so that no text is sorted
    ids = labels.where("toxic = 1").select("doc_id").orderBy(order, "doc_id").limit(POSITIVES)
    positives = short.join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"])
    some = docs.select("doc_id").orderBy(order, "doc_id").limit(UNLABELLED)
    unlabelled = short.join(F.broadcast(some.distinct()), "doc_id").dropDuplicates(["doc_id"])
    return fit(_lists(positives), _lists(unlabelled), min(max(share, 1e-3), 0.5))


def _lists(docs: DataFrame) -> list[np.ndarray]:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = features(batch.column("text"))
            ends = np.cumsum(np.bincount(rows, minlength=len(batch)))
            raw = found.astype("<i4")
            lists = [raw[a:b].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lists, pa.binary())], ["doc_id", "found"])

    got = docs.select("doc_id", "text").mapInArrow(read, "doc_id long, found binary").collect()
    return [np.frombuffer(r["found"], "<i4").astype(np.int64) for r in sorted(got, key=lambda r: r["doc_id"])]


def scorer(spark: SparkSession, model: Model):
    """A column function from texts to scores."""
    ship(spark)
    sent = spark.sparkContext.broadcast(model)  # FEATURES weights

    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string(), from_pandas=True)], ["text"])
        parts = [sent.value.score(part.column("text")) for part in text_slices(batch)]
        return pd.Series(np.concatenate([np.zeros(0), *parts]))

    return rate


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All rows: doc_id, text, score."""
    return pick(docs, "doc_id", "text").withColumn("score", scorer(docs.sparkSession, model)("text"))
