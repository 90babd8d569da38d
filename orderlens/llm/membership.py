"""Which numbers may be among many others, said by a bitmap of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orderlens.llm.shingles import mix

#: Most bytes of a filter.
FILTER_BYTES = 32 * 1024 * 1024


class Filter:
    """Says of numbers whether they may be among those it was made of (never wrongly no)."""

    def __init__(self, size: int):
        self.bits = np.zeros(max(64, min(size, FILTER_BYTES)), np.uint8)

    def _places(self, numbers: np.ndarray) -> list[np.ndarray]:
        n = numbers.astype(np.int64).view(np.uint64)
        return [mix(n ^ np.uint64(s)) % np.uint64(8 * len(self.bits)) for s in (1, 2, 3)]

    def add(self, numbers: np.ndarray) -> None:
        for p in self._places(numbers):
            np.bitwise_or.at(self.bits, (p >> np.uint64(3)).astype(np.int64), (1 << (p & np.uint64(7))).astype(np.uint8))

    def has(self, numbers: np.ndarray) -> np.ndarray:
        out = np.ones(len(numbers), bool)
        for p in self._places(numbers):
            out &= (self.bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def filter_of(numbers: DataFrame) -> Filter:
    """Two bytes a number, made in the tasks and joined here; its size has a bound."""
    column = numbers.columns[0]
    size = 2 * numbers.count()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filter(size)
        for batch in batches:
            own.add(batch.column(column).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array([own.bits.tobytes()], pa.binary())], ["bits"])

    out = Filter(size)
    for row in numbers.coalesce(8).mapInArrow(partial, "bits binary").toLocalIterator():
        out.bits |= np.frombuffer(row["bits"], np.uint8)
    return out
