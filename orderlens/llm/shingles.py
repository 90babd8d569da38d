"""Distinct word shingles of texts as sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _byte_table() -> np.ndarray:
    """A-Z in lower case, ASCII white space as a space, all else as it is."""
    t = np.arange(256, dtype=np.uint8)
    t[ord("A") : ord("Z") + 1] += 32
    t[9:14] = 32
    return t


_TABLE = _byte_table()


def plain_text(texts: pa.Array, lines: bool = False) -> pa.Array:
    """Texts in lower case with spaces for white space, but for line ends if ``lines``."""
    table = _TABLE
    if lines:
        table = table.copy()
        table[10] = 10
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = table[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
    shifted = np.ascontiguousarray(offsets - offsets[0])
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(shifted), pa.py_buffer(data)])


def mix(x: np.ndarray) -> np.ndarray:
    """Well mixed 64 bits of each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z in lower case, split at ASCII white space), and words per text."""
    if not len(texts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lists = pc.split_pattern(plain_text(texts), " ")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    own = np.array([xxhash.xxh64_intdigest(w.encode()) for w in words], np.uint64)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    full = np.array([bool(w) for w in words], bool)[codes] if words else np.zeros(0, bool)
    rows = np.repeat(np.arange(len(texts)), counts)[full]
    return own[codes[full]], np.bincount(rows, minlength=len(texts))


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, one text after the other, and how many it has.

    A shingle is ``size`` words in a row; fewer words make one shingle; none, none.
    """
    words, counts = word_hashes(texts)
    starts = np.cumsum(counts) - counts
    length = np.minimum(counts, size)
    number = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    rows = np.repeat(np.arange(len(counts)), number)
    first = np.arange(len(rows)) - np.repeat(np.cumsum(number) - number, number) + np.repeat(starts, number)
    own = length[rows]
    hashes = own.astype(np.uint64)
    for k in range(size):
        live = own > k
        hashes[live] = mix(hashes[live] * _ODD + words[first[live] + k])
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.bincount(rows[new], minlength=len(counts))


def per_row(values: np.ndarray, counts: np.ndarray, reduce: np.ufunc, empty: int = 0) -> np.ndarray:
    """``reduce`` over each row's stretch of ``values``; rows without values get ``empty``."""
    out = np.full(len(counts), empty, values.dtype)
    full = counts > 0
    if full.any():
        out[full] = reduce.reduceat(values, (np.cumsum(counts) - counts)[full])
    return out
