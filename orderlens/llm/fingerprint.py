"""Document fingerprints by consistent weighted sampling.

The terms of a text are its words (runs without white space, in lower case), weighted
by how often they occur.  For each of the samples a term draws, from hashes of itself,
two gamma variables and a uniform one; these fix a grid of weights for the term, and
the term with the least cost at its grid point below its weight is the sample.  Two
texts give the same sample with a probability of their generalised Jaccard
similarity: the sum of the lesser weights over the sum of the greater ones.

Bad input: a null text is empty; an empty text, or one of white space only, has the
fingerprint of zeros, which is like itself only; null ids come first; rows of one id
follow each other by text; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

from orderlens.llm.ranges import by_id
from orderlens.llm.tokens import text_slices

SAMPLES = 96
#: Bytes of text in a partition.
PIECE_BYTES = 16 * 1024 * 1024
#: Terms whose variables are drawn at once.
_TERMS = 4096


def _mix(x: np.ndarray) -> np.ndarray:
    """Well mixed 64 bits of each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(bits: np.ndarray) -> np.ndarray:
    return (bits.astype(np.float64) + 0.5) * 2.0**-32


def _draws(hashes: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r and log c (gamma of shape 2) and the uniform b of each term (row) and sample (column)."""
    low = np.uint64(0xFFFFFFFF)
    sample = np.arange(1, 3 * samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    one, two, three = (_mix(hashes[:, None] + s) for s in np.split(sample, 3))
    r = -np.log(_uniform(one & low) * _uniform(one >> np.uint64(32)))
    c = np.log(-np.log(_uniform(two & low) * _uniform(two >> np.uint64(32))))
    return r, c, _uniform(three & low)


def _costs(hashes: np.ndarray, weights: np.ndarray, samples: int) -> np.ndarray:
    """Log cost of each weighted term in each sample; rounded, so that it is the same wherever it is worked out."""
    r, c, b = _draws(hashes, samples)
    grid = np.floor(np.log(weights.astype(np.float64))[:, None] / r + b)
    return (c - r * (grid - b) - r).astype(np.float32)


def signatures(texts: pa.Array, samples: int = SAMPLES) -> np.ndarray:
    """16 bits per text and sample; zeros for a text without words."""
    lists = [t.lower().split() for t in pc.fill_null(texts.cast(pa.large_string()), "").to_pylist()]
    coded = pa.array([w for own in lists for w in own], pa.large_string()).dictionary_encode()
    words = coded.dictionary.to_pylist()
    rows = np.repeat(np.arange(len(lists)), [len(own) for own in lists])
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pairs, weights = np.unique(rows * max(len(words), 1) + codes, return_counts=True)
    rows, codes = np.divmod(pairs, max(len(words), 1))
    out = np.zeros((len(lists), samples), np.uint16)
    if not len(rows):
        return out
    hashes = np.array([xxhash.xxh64_intdigest(w.encode()) for w in words], np.uint64)
    once = np.empty((len(words), samples), np.float32)
    for a in range(0, len(words), _TERMS):
        part = hashes[a : a + _TERMS]
        once[a : a + _TERMS] = _costs(part, np.ones(len(part)), samples)
    starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    # a text's terms of weight 1 come from the table, the heavier ones are worked out
    for first, last in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=True):
        best = np.full(samples, np.inf, np.float32)
        for low in range(first, last, _TERMS):
            own, weight = codes[low : min(last, low + _TERMS)], weights[low : min(last, low + _TERMS)]
            np.minimum(best, once[own].min(axis=0, initial=np.inf, where=(weight == 1)[:, None]), out=best)
            heavy = weight > 1
            if heavy.any():
                np.minimum(best, _costs(hashes[own[heavy]], weight[heavy], samples).min(axis=0), out=best)
        out[rows[first]] = np.maximum(_mix(best.view(np.uint32).astype(np.uint64)) >> np.uint64(48), 1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples."""
    return (a == b).mean(axis=1)


def edit(text: str, following: str) -> str:
    """The second half of a text replaced by the beginning of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def compare_with_next(docs: DataFrame, samples: int = SAMPLES, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Each text's fingerprint, its edited text's, and how alike they and the next document's are."""
    dealt, _ = by_id(docs, piece_bytes, with_next=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # the row still waiting for the next one
        done = False
        for batch in (part for whole in batches for part in text_slices(whole, size=4 << 20)):
            own = np.flatnonzero(~batch.column("ahead").to_numpy(zero_copy_only=False))
            n = min(len(own) + 1, len(batch))  # all own rows, and the first that comes from ahead
            if done or not n:
                continue
            done = len(own) < len(batch)
            ids = batch.column("doc_id").slice(0, n).to_pylist()
            texts = [t or "" for t in batch.column("text").slice(0, n).to_pylist()]
            if last is not None:
                ids, texts = [last[0], *ids], [last[1], *texts]
            edited = [edit(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
            # together, since an edited text has the words of the two it is made of
            new = texts[len(texts) - n :]
            both = signatures(pa.array(new + edited, pa.large_string()), samples)
            signed, changed = both[:n], both[n:]
            if last is not None:
                signed = np.concatenate([last[2][None], signed])
            last = (ids[-1], texts[-1], signed[-1])
            if not edited:
                continue
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[:-1], pa.int64()),
                    pa.array([len(t) for t in texts[:-1]], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                    pa.array([s.tobytes().hex() for s in signed[:-1]], pa.string()),
                    pa.array([s.tobytes().hex() for s in changed], pa.string()),
                    pa.array(likeness(signed[:-1], changed), pa.float64()),
                    pa.array(likeness(signed[:-1], signed[1:]), pa.float64()),
                ],
                [c.split()[0] for c in _SCHEMA.split(", ")],
            )

    return dealt.mapInArrow(run, _SCHEMA)
