"""Token ids of whole texts, through the vocabulary files of public tokenizers.

A tokenizer that splits at white space before it merges gives the same ids for a
text and for its chunks, as long as no chunk border touches a run of white space.  Names
of added tokens in a text become their ids, as the library does by default.
Most words of a corpus repeat, so each worker remembers the ids of words, and gives
only new ones to the library: plain Latin words straight to its merges, everything
else through the whole tokenizer.
"""

from __future__ import annotations

import array
import gc
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of either half of a memory; the older half goes when the younger is full.
MEMORY = 350_000
#: Texts up to this size are encoded together.
BATCH_BYTES = 4 * 1024 * 1024

#: Unicode's white space, for two regular expression engines.
_SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_RUN = _SPACE + _SPACE
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
_ENCODERS: dict[str, ChunkEncoder] = {}


_LETTER, _MARK = "A-Za-zÀ-ÖØ-öø-ÿ", r".,;:!?()\"+@=_%&*#$/<>\[\]{}|~^\\-"
_PLAIN = f"[{_LETTER}0-9{_MARK}]+"
#: Chunks of plain words, with at most single spaces or line ends before them.
_SIMPLE = re.compile(f"[ \n]?{_PLAIN}(?:\n{_PLAIN})*")
#: Pieces that the two kinds of tokenizers make of such a chunk.
#: What keeps a text from being such chunks throughout: another letter, white space in a row, or a space at the end.
_ODD = rf"[^ \n{_LETTER}0-9{_MARK}]|{_RUN}| \z"
_BYTE_PIECES = re.compile(f" ?[{_LETTER}]+| ?[0-9]+| ?[{_MARK}]+|\n")
_WORD_PIECES = re.compile(f"[{_LETTER}]+|[0-9]|[{_MARK}]+")


def _byte_letters() -> dict[int, int]:
    """The letters that byte-level vocabularies write for the bytes that don't stand for themselves."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: next(others) for b in range(256) if b not in own}


def _byte_kinds() -> np.ndarray:
    """Kinds of the bytes of plain texts: 0 letter, 1 mark, 2 digit, 3 white space."""
    kinds = np.ones(256, np.uint8)
    for first, last in ((b"A", b"Z"), (b"a", b"z"), (b"\x80", b"\xff")):  # beyond ASCII plain texts have letters only
        kinds[first[0] : last[0] + 1] = 0
    kinds[ord("0") : ord("9") + 1] = 2
    kinds[[ord(" "), ord("\n")]] = 3
    return kinds


_KINDS = _byte_kinds()


def plain_pieces(texts: pa.Array, words: bool) -> tuple[pa.Array, np.ndarray]:
    """All pieces of plain texts (without what ``_ODD`` finds), and how many each text has.

    They are those that ``_WORD_PIECES`` finds if ``words``, else those of ``_BYTE_PIECES``.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    kinds = _KINDS[data]
    first = np.ones(len(data), bool)
    first[1:] = kinds[1:] != kinds[:-1]
    if words:
        first |= kinds == 2
    else:  # a plain text has white space one by one, and a space belongs to what comes after it
        first[1:] &= data[:-1] != 32
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    if words:
        full = kinds != 3
        upto = np.concatenate([[0], np.cumsum(full)])
        first, data, offsets = first[full], data[full], upto[offsets]
    starts = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(starts, offsets))
    ends = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, ends, pa.py_buffer(np.ascontiguousarray(data))]), counts


class Memory:
    """A dictionary of bounded size that forgets what was not asked for lately."""

    def __init__(self, size: int = 0):
        self.size = size or MEMORY
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def find(self, keys: list[str]) -> tuple[list[bytes | None], list[int]]:
        """What is known of distinct keys, and the places of those that are not."""
        young, old = self.young, self.old
        out = list(map(young.get, keys))
        new = [i for i, known in enumerate(out) if known is None]
        if old and new:
            missing = []
            for i in new:
                known = old.get(keys[i])
                if known is None:
                    missing.append(i)
                else:
                    young[keys[i]] = out[i] = known
            new = missing
        return out, new

    def trim(self) -> None:
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}


class ChunkEncoder:
    """Ids by one tokenizer file, chunk by chunk.

    Keys: a chunk after one plain space is kept under its own name; any other
    chunk under its name after two spaces, which no chunk of the first kind holds.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.words = Memory()
        self.lower, self.pieces = False, None
        made = json.loads(self.tokenizer.to_str())
        # an added token is found in the raw text wherever its name stands, so a chunk with a name goes to the library
        added = made["added_tokens"] or []
        self.names = [t["content"] for t in added]
        self.added = re.compile("|".join(map(re.escape, self.names)))
        self.named = False
        # one that takes in white space, or holds some, or is found after normalising, may reach across chunks
        across = ("lstrip", "rstrip", "single_word", "normalized")
        self.whole = any(any(t[f] for f in across) or re.search(r"\s", t["content"]) for t in added)
        split = made["pre_tokenizer"] or {}
        if split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"] and not made["normalizer"]:
            self.pieces = _BYTE_PIECES
        elif "Lowercase" in str(made["normalizer"]) and "[\\\\p{N}]|" in str(split):
            self.lower, self.pieces = True, _WORD_PIECES

    def _words(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces, new ones from the merges; a piece has the key of the chunk that it would be alone."""
        keys = pieces if self.lower else [p[1:] if p[0] == " " else "  " + p for p in pieces]
        out, new = self.words.find(keys)
        own = [i for i in new if pieces[i].isascii() and pieces[i] != "\n"]  # letters, digits and marks stand for themselves
        spelt = "\n".join([pieces[i] for i in own]).replace(" ", chr(self.letters[32])).split("\n") if own else []
        if len(own) < len(new):
            others = [i for i in new if not pieces[i].isascii() or pieces[i] == "\n"]
            spelt += [pieces[i].encode().decode("latin-1").translate(self.letters) for i in others]
            own += others
        young, tokenize, numbers = self.words.young, self.model.tokenize, array.array
        for i, word in zip(own, spelt, strict=True):
            young[keys[i]] = out[i] = numbers("I", [t.id for t in tokenize(word)]).tobytes()
        return out

    def _simple(self, chunks: list[str]) -> list[bytes]:
        """Ids of simple chunks, put together from those of their pieces."""
        split = [self.pieces.findall(c.lower() if self.lower else c) for c in chunks]
        distinct = list({p: None for found in split for p in found})
        ids = dict(zip(distinct, self._words(distinct), strict=True))
        return [b"".join(map(ids.__getitem__, found)) for found in split]

    def _ids(self, keys: list[str]) -> list[bytes]:
        """Ids of distinct keys, after learning the new ones.

        Words are remembered, and chunks that are not plain; chunks of several plain
        words are put together again from them.
        """
        out, new = self.words.find(keys)
        simple: tuple[list[int], list[str]] = [], []
        rest: tuple[list[int], list[str]] = [], []
        for i in new:
            key = keys[i]
            chunk = key[2:] if key[:2] == "  " else " " + key
            plain = self.pieces is not None and _SIMPLE.fullmatch(chunk) and not (self.named and self.added.search(chunk))
            at, chunks = simple if plain else rest
            at.append(i)
            chunks.append(chunk)
        for i, known in zip(simple[0], self._simple(simple[1]), strict=True):
            out[i] = known
        if rest[0]:
            found = self.tokenizer.encode_batch_fast(rest[1], add_special_tokens=False)
            for i, e in zip(rest[0], found, strict=True):
                self.words.young[keys[i]] = out[i] = array.array("I", e.ids).tobytes()
        self.words.trim()
        return out

    def _chunks(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Keys of all chunks in order, and how many each text has."""
        plain = pc.split_pattern(texts, " ")
        counts = pc.list_value_length(plain).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = plain.flatten()
        starts = np.cumsum(counts) - counts
        first = np.zeros(len(flat), bool)
        first[starts[counts > 0]] = True
        two, none = pa.scalar("  ", pa.large_string()), pa.scalar("", pa.large_string())
        heads = pc.binary_join_element_wise(two, flat.filter(pa.array(first)), none)
        flat = pc.replace_with_mask(flat, pa.array(first), heads)
        rough = np.flatnonzero(pc.match_substring_regex(texts, _RUN).to_numpy(zero_copy_only=False))
        if len(rough) == 0:
            return flat, counts
        pieces, last = [], 0
        for i in rough.tolist():
            pieces.append(flat.slice(last, starts[i] - last))
            own = ["  " + c for c in _CHUNK.findall(texts[i].as_py())]
            pieces.append(pa.array(own, flat.type))
            last, counts[i] = starts[i] + counts[i], len(own)
        pieces.append(flat.slice(last))
        return pa.concat_arrays(pieces), counts

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the number of ids of each text.

        A null text counts as empty and has no ids.
        """
        texts = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts, "")
        if len(texts) == 0:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.named = any(pc.any(pc.match_substring(texts, n)).as_py() for n in self.names)
        if self.whole:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)
        collecting = gc.isenabled()
        gc.disable()  # many small objects live through a batch; looking through them again and again is waste
        try:
            return self._encode(texts.cast(pa.large_string()))
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Plain texts piece by piece, the others chunk by chunk, put together in their order."""
        odd = np.ones(len(texts), bool)
        if self.pieces is not None:
            odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
            for n in self.names if self.named else ():
                odd |= pc.match_substring(texts, n).to_numpy(zero_copy_only=False)
        if odd.all():
            return self._by_chunks(texts)
        plain, plain_counts = self._by_pieces(texts.filter(pa.array(~odd)))
        if not odd.any():
            return plain, plain_counts
        others, other_counts = self._by_chunks(texts.filter(pa.array(odd)))
        counts = np.zeros(len(texts), np.int64)
        counts[~odd], counts[odd] = plain_counts, other_counts
        from_odd = np.repeat(odd, counts)
        flat = np.empty(len(from_odd), np.uint32)
        flat[~from_odd], flat[from_odd] = plain, others
        return flat, counts

    def _by_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain texts; each distinct piece is looked up once."""
        pieces, counts = plain_pieces(pc.utf8_lower(texts) if self.lower else texts, self.lower)
        coded = pieces.dictionary_encode()
        found = self._words(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        self.words.trim()
        own = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4)])
        ids = pa.array(np.frombuffer(b"".join(found), np.uint32))
        codes = coded.indices.to_numpy(zero_copy_only=False)
        flat = pa.LargeListArray.from_arrays(pa.array(own), ids).take(coded.indices).flatten()
        upto = np.concatenate([[0], np.cumsum(np.diff(own)[codes])])
        ends = np.concatenate([[0], np.cumsum(counts)])
        return flat.to_numpy(zero_copy_only=False), upto[ends[1:]] - upto[ends[:-1]]

    def _by_chunks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = self._chunks(texts)
        coded = keys.dictionary_encode()
        found = self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        codes = coded.indices.to_numpy(zero_copy_only=False)
        flat = np.frombuffer(b"".join(map(found.__getitem__, codes.tolist())), np.uint32)
        own = np.fromiter(map(len, found), np.int64, len(found)) // 4
        upto = np.concatenate([[0], np.cumsum(own[codes])])
        ends = np.concatenate([[0], np.cumsum(counts)])
        return flat, upto[ends[1:]] - upto[ends[:-1]]


def text_slices(batch: pa.RecordBatch, column: str = "text", size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with near ``size`` bytes of text, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    first = 0
    while first < len(batch):
        last = max(first + 1, int(np.searchsorted(upto, upto[first] + size, side="right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder of this file, made at first use."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]
