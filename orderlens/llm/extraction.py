"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is the sequence of its leaf blocks.  Features are the elements around a block,
the words of their class and id names, and the form of the text; a weight for each
feature and label, and for each pair of labels in a row, is fitted by maximum likelihood
on labelled pages.  The Viterbi path says which blocks are main text.

Bad input: a null or empty page, or one without text, has an empty main text; broken
markup is read as far as it goes, loose signs as text, in time that grows with the page
only; repeated rows are read each;
other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orderlens.llm.common import pick, ship
from orderlens.llm.htmlblocks import Block, Element, blocks_of
from orderlens.llm.labelled_pages import page
from orderlens.llm.tokens import text_slices

#: Labelled pages trained on, steps of the fit, and the strength of its prior.
PAGES, STEPS, RATE, DECAY = 900, 150, 0.1, 0.001

_END = re.compile(r"[.!?…:;\"»”)]$")


def _bucket(n: float, borders: tuple[float, ...]) -> int:
    return sum(n >= b for b in borders)


def _of_block(block: Block) -> list[str]:
    """What the model sees of a block itself."""
    size = len(block.text)
    out = ["bias", f"size={_bucket(size, (10, 25, 60, 120, 300))}", f"linked={_bucket(block.linked / max(size, 1), (0.01, 0.3, 0.7))}"]
    out.append(f"end={bool(_END.search(block.text))}")
    if block.controls:
        out.append("controls")
    if "©" in block.text[:40]:
        out.append("sign")
    return out


def features(block: Block) -> list[str]:
    """What the model sees of a block and of the elements around it."""
    out = _of_block(block)
    if block.inside is not None:
        out.append(f"parent={block.inside.tag}")
        for e in block.inside.outwards():
            out += e.fresh
        near = block.inside.words | (block.inside.parent.words if block.inside.parent else frozenset())
        out += [f"own={w}" for w in near]
    return out


def _label(block: Block) -> int:
    for e in block.inside.outwards() if block.inside else ():
        if e.label is not None:
            return int(e.label)
    return 0


class Field:
    """Weights: per feature and label, per pair of labels, and per first label."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, step: np.ndarray, first: np.ndarray):
        self.names, self.emit, self.step, self.first = names, emit, step, first
        self.weights = dict(zip(names, map(tuple, emit.tolist()), strict=True))

    def _sum(self, names: Iterable[str]) -> tuple[float, float]:
        a = b = 0.0
        for f in names:
            if w := self.weights.get(f):
                a, b = a + w[0], b + w[1]
        return a, b

    def _sums(self, element: Element | None) -> tuple[float, ...]:
        """What the elements add: all around, this one, its own words (a, b each); each element is summed once."""
        todo = []
        while element is not None and element.sums is None:
            todo.append(element)
            element = element.parent
        above = element.sums if element is not None else (0.0,) * 6
        for e in reversed(todo):
            around, here = self._sum(e.fresh), self._sum((f"parent={e.tag}",))
            own = beside = (0.0, 0.0)
            if e.words:
                parent = e.parent.words if e.parent else frozenset()
                own = self._sum([f"own={w}" for w in e.words])
                beside = self._sum([f"own={w}" for w in e.words if w not in parent]) if parent else own  # the parent's count once
            near = [here[c] + beside[c] + above[4 + c] for c in (0, 1)]
            e.sums = above = (above[0] + around[0], above[1] + around[1], *near, *own)
        return above

    def decode(self, blocks: list[Block]) -> list[bool]:
        """Most likely labels of a page's blocks."""
        if not blocks:
            return []
        (s00, s01), (s10, s11) = self.step.tolist()
        back: list[tuple[int, int]] = []
        a = b = 0.0
        for i, block in enumerate(blocks):
            e0, e1 = self._sum(_of_block(block))
            if block.inside is not None:
                a0, a1, n0, n1, _, _ = self._sums(block.inside)
                e0, e1 = e0 + a0 + n0, e1 + a1 + n1
            if i == 0:
                a, b = self.first[0] + e0, self.first[1] + e1
                continue
            back.append((int(b + s10 > a + s00), int(b + s11 > a + s01)))
            a, b = max(a + s00, b + s10) + e0, max(a + s01, b + s11) + e1
        path = [int(b > a)]
        for from0, from1 in reversed(back):
            path.append(from1 if path[-1] else from0)
        return [bool(x) for x in reversed(path)]


def fit(pages: list[str]) -> Field:
    """Maximise the likelihood of the labels in labelled pages, by gradient steps over all pages at once."""
    sequences = [s for p in pages if (s := blocks_of(p))]
    names: dict[str, int] = {}
    found = [[[names.setdefault(f, len(names)) for f in features(b)] for b in s] for s in sequences]
    labels = [[_label(b) for b in s] for s in sequences]
    n, t = len(sequences), max(map(len, sequences))
    real = np.array([[i < len(s) for i in range(t)] for s in sequences])
    y = np.array([row + [0] * (t - len(row)) for row in labels])
    place = np.concatenate([np.full(len(f), s * t + i) for s, fs in enumerate(found) for i, f in enumerate(fs)])
    feature = np.concatenate([f for fs in found for f in fs])
    emit, step, first = np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)
    hot = np.eye(2)[y] * real[:, :, None]
    seen_pairs = np.einsum("nti,ntj->ij", hot[:, :-1], hot[:, 1:])
    state = [np.zeros_like(w) for w in (emit, step, first) for _ in range(2)]
    for k in range(1, STEPS + 1):
        score = np.stack([np.bincount(place, emit[feature, c], n * t) for c in (0, 1)], axis=1).reshape(n, t, 2)
        forward, backward = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        forward[:, 0] = score[:, 0] + first
        for i in range(1, t):
            now = np.logaddexp(*(forward[:, i - 1, c, None] + step[c] for c in (0, 1))) + score[:, i]
            forward[:, i] = np.where(real[:, i, None], now, forward[:, i - 1])
        for i in range(t - 2, -1, -1):
            ahead = score[:, i + 1] + backward[:, i + 1]
            now = np.logaddexp(*(step[:, c] + ahead[:, c, None] for c in (0, 1)))
            backward[:, i] = np.where(real[:, i + 1, None], now, 0)
        whole = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        share = np.exp(forward + backward - whole[:, None, None]) * real[:, :, None]
        ahead = (score + backward)[:, 1:, None, :]
        pairs = np.exp(forward[:, :-1, :, None] + step + ahead - whole[:, None, None, None]) * real[:, 1:, None, None]
        apart = (hot - share).reshape(n * t, 2)
        slopes = [
            np.stack([np.bincount(feature, apart[place, c], len(names)) for c in (0, 1)], axis=1) / n - DECAY * emit,
            (seen_pairs - pairs.sum(axis=(0, 1))) / n - DECAY * step,
            (hot[:, 0] - share[:, 0]).sum(axis=0) / n - DECAY * first,
        ]
        for w, (weights, slope) in enumerate(zip((emit, step, first), slopes, strict=True)):
            m, v = state[2 * w], state[2 * w + 1]
            m += 0.1 * (slope - m)
            v += 0.01 * (slope**2 - v)
            weights += RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Field(names, emit, step, first)


@functools.cache
def trained() -> Field:
    """The field fitted on the labelled pages."""
    return fit([page(seed) for seed in range(PAGES)])


def main_text(field: Field, html: str | None) -> str:
    blocks = blocks_of(html)
    return "\n".join(b.text for b, main in zip(blocks, field.decode(blocks), strict=True) if main)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    spark = pages.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(field or trained())  # weights of the features of the labelled pages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole, "html")):
            texts = [main_text(sent.value, h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pick(pages, "page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
