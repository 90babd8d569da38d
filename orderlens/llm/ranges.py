"""Cut rows at exact weights along a sorted key, without sorting them.

Rounds of counting replace the sort: every task counts the weight of its rows below
a few probes around each wanted cut, the counts are added up, and each cut is closed
in on between the two probes around it.  The driver sees probes and their counts
only; their number follows the number of cuts, not the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.llm.common import pick, ship, stage

LOW, HIGH = -(2**63), 2**63 - 1
#: Probes of one round over all cuts, as far as each cut still gets two.
ROUND_PROBES = 8192


@dataclass
class Splits:
    """Cuts: a row belongs to piece i if it lies at or above cut i - 1 and below cut i.

    ``keys`` and ``ids`` hold the cuts, ``weight_below`` and ``rows_below`` what lies
    below them, starting with 0 for the first piece.
    """

    keys: np.ndarray
    ids: np.ndarray
    weight_below: np.ndarray
    rows_below: np.ndarray
    total_weight: int
    total_rows: int

    def place(self, keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Piece of each row."""
        piece = np.searchsorted(self.keys, keys, side="right")
        tied = np.searchsorted(self.keys, keys, side="left") < piece
        for i in np.flatnonzero(tied):
            while piece[i] > 0 and self.keys[piece[i] - 1] == keys[i] and self.ids[piece[i] - 1] > ids[i]:
                piece[i] -= 1
        return piece


def _count(rows: DataFrame, column: str, probes: np.ndarray, only: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weight and number of rows below each probe; with ``only`` below (only, probe) of the same key."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight = np.zeros(len(probes) + 1, np.int64)
        number = np.zeros(len(probes) + 1, np.int64)
        for f in frames:
            at = np.searchsorted(probes, f[column].to_numpy(), side="right")
            weight += np.bincount(at, f["weight"].to_numpy(), len(probes) + 1).astype(np.int64)
            number += np.bincount(at, minlength=len(probes) + 1)
        full = np.flatnonzero(number)
        yield pd.DataFrame({"bin": full, "weight": weight[full], "number": number[full]})

    parts = rows.select(column, "weight").mapInPandas(partial, "bin long, weight long, number long")
    got = parts.groupBy("bin").agg(F.sum("weight").alias("weight"), F.sum("number").alias("number")).collect()
    weight, number = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for r in got:
        weight[r["bin"]], number[r["bin"]] = r["weight"], r["number"]
    return np.cumsum(weight)[:-1], np.cumsum(number)[:-1]


class _Search:
    """Closes in on all cuts along one column."""

    def __init__(self, targets: list[int], base: tuple[int, int], top: tuple[int, int], low: int, high: int):
        self.targets = targets
        self.low = [(low, *base)] * len(targets)  # place, weight and rows below it; weight <= target
        self.high = [(high, *top)] * len(targets)  # weight > target

    def run(self, count, tolerance: int) -> None:
        while True:
            open_ = [
                i
                for i, t in enumerate(self.targets)
                if self.high[i][0] - self.low[i][0] > 1 and min(t - self.low[i][1], self.high[i][1] - t) > tolerance
            ]
            if not open_:
                return
            fan = max(2, min(64, ROUND_PROBES // len(open_)))
            probes = set()
            for i in open_:
                a, b = self.low[i][0], self.high[i][0]
                probes.update(a + (b - a) * k // (fan + 1) for k in range(1, fan + 1))
                probes.add(a + 1)
            places = sorted(p for p in probes if LOW < p <= HIGH)
            weight, rows = count(np.array(places, np.int64))
            known = [(p, int(w), int(r)) for p, w, r in zip(places, weight, rows, strict=True)]
            below = np.array([k[1] for k in known])
            for i in open_:
                at = int(np.searchsorted(below, self.targets[i], side="right"))
                if at > 0 and known[at - 1][0] > self.low[i][0]:
                    self.low[i] = known[at - 1]
                if at < len(known) and known[at][0] < self.high[i][0]:
                    self.high[i] = known[at]

    def nearest(self, i: int) -> tuple[int, int, int]:
        t = self.targets[i]
        return self.low[i] if t - self.low[i][1] <= self.high[i][1] - t else self.high[i]


def find_splits(rows: DataFrame, pieces: int, tolerance: float = 0.005, unit: int = 1) -> Splits:
    """Cuts of ``rows`` (key, id, weight: long, not null; read several times) into equal weights.

    A cut is good when the weight below it is within ``tolerance`` of ``unit`` average
    pieces.  Rows of one key stay together where a border of the key is good
    enough; otherwise the key is cut between two ids.
    """
    total = rows.agg(F.sum("weight").alias("w"), F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).first()
    weight, number = int(total["w"] or 0), int(total["n"])
    if not number or pieces < 2:
        nothing = np.zeros(0, np.int64)
        return Splits(nothing, nothing, np.zeros(1, np.int64), np.zeros(1, np.int64), weight, number)
    targets = [weight * i // pieces for i in range(1, pieces)]
    allowed = int(tolerance * unit * weight / pieces)
    search = _Search(targets, (0, 0), (weight, number), int(total["lo"]), int(total["hi"]) + 1)
    search.run(lambda p: _count(rows, "key", p), allowed)
    cuts = [(*search.nearest(i), LOW) for i in range(len(targets))]
    heavy: dict[int, list[int]] = {}
    for i, t in enumerate(targets):
        if search.high[i][0] - search.low[i][0] == 1 and abs(cuts[i][1] - t) > allowed:
            heavy.setdefault(search.low[i][0], []).append(i)
    for key, members in heavy.items():  # at most one key per cut
        own = rows.where(F.col("key") == key)
        edge = own.agg(F.min("id").alias("lo"), F.max("id").alias("hi")).first()
        first, last = search.low[members[0]], search.high[members[0]]
        inner = _Search(
            [targets[i] - first[1] for i in members],
            (0, 0),
            (last[1] - first[1], last[2] - first[2]),
            int(edge["lo"]),
            int(edge["hi"]) + 1,
        )
        inner.run(lambda p, own=own: _count(own, "id", p), allowed)
        for k, i in enumerate(members):
            place, w, n = inner.nearest(k)
            if place > int(edge["hi"]):
                cuts[i] = (key + 1, last[1], last[2], LOW)
            else:
                cuts[i] = (key, first[1] + w, first[2] + n, place)
    cuts.sort(key=lambda c: (c[0], c[3]))
    return Splits(
        np.array([min(c[0], HIGH) for c in cuts], np.int64),
        np.array([c[3] for c in cuts], np.int64),
        np.array([0, *(c[1] for c in cuts)], np.int64),
        np.array([0, *(c[2] for c in cuts)], np.int64),
        weight,
        number,
    )


def by_id(docs: DataFrame, piece_bytes: int, with_next: bool = False) -> tuple[DataFrame, int]:
    """``docs`` (doc_id, text) with ``piece``, dealt so that pieces hold ascending ids and near equal bytes.

    Each piece is one partition, sorted by id; a null id comes first, rows of one id
    by their text.  With ``with_next`` a piece also gets, marked ``ahead`` and last,
    the first rows of the next piece that has any (of the first, after the last).
    Returns the frame and the number of pieces.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = pick(docs, "doc_id", "text")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW))
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    sizes = docs.select(key.alias("key"), F.lit(0).cast("long").alias("id"), size.cast("long").alias("weight"))
    sizes = stage(sizes, "sizes")
    total = sizes.agg(F.sum("weight")).first()[0] or 0
    pieces = max(1, -(-total // piece_bytes))
    splits = find_splits(sizes, pieces, 0.05)
    cuts = splits.keys

    @F.pandas_udf(T.IntegerType())
    def place(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, k.to_numpy(), side="right").astype(np.int32))

    dealt = docs.withColumn("key", key).withColumn("piece", place("key"))
    order = ["piece", F.col("doc_id").asc_nulls_first(), "text"]
    if with_next:
        heads = sizes.groupBy(place("key").alias("piece")).agg(F.min("key").alias("key")).orderBy("piece").collect()
        firsts = np.array([h["key"] for h in heads], np.int64)  # one a piece, ascending
        before = np.array([h["piece"] for h in [*heads[-1:], *heads[:-1]]], np.int32)

        @F.pandas_udf(T.IntegerType())
        def also(k: pd.Series) -> pd.Series:
            at = np.searchsorted(firsts, k.to_numpy())
            at = np.minimum(at, len(firsts) - 1)
            return pd.Series(np.where(firsts[at] == k.to_numpy(), before[at], -1).astype(np.int32))

        own = F.struct("piece", F.lit(False).alias("ahead"))
        ahead = F.struct(F.col("also").alias("piece"), F.lit(True).alias("ahead"))
        both = F.when(F.col("also") >= 0, F.array(own, ahead)).otherwise(F.array(own))
        dealt = dealt.withColumn("also", also("key")).select("doc_id", "text", F.explode(both).alias("to"))
        dealt = dealt.select("doc_id", "text", "to.piece", "to.ahead")
        order.insert(1, "ahead")
    dealt = dealt.drop("key")
    return dealt.repartitionById(pieces, "piece").sortWithinPartitions(*order), pieces
