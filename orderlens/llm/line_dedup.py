"""Line de-duplication by an exact set-similarity join.

A line is the set of its words (split at ASCII white space, A-Z in lower case).  Lines
stand in the order of their documents' ids and their places in the text.  A line is
removed if an earlier line, itself removed or not, has a Jaccard similarity of 0.8 or
more to it; so exactly the first of equal lines can stay.  Lines without words stay.

1. How often words occur is counted over all lines, in a fixed number of cells; the
   words of a line are ordered by that, the rarest first.
2. Similar lines share one of their first words.  Lines meet under each of these words,
   and a pair goes on only if its lengths and the word's places leave room for enough
   common words, and if not too many bits of the two lines' parity bitmaps differ (a
   lower bound of the words they don't share).  None of this loses a similar pair.
3. Full sets decide.  Under a word that many lines share, each line names its nearest
   earlier lines first; lines that no match removes name the next ones, round after
   round, until none is left.  So large groups of copies don't make all their pairs.

Bad input: a null text stays null and has no lines; rows equal in id and text count as
one document, so their lines stay or go together; a null id comes first; other columns
are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import scratch, ship, stage, with_rest
from orderlens.llm.membership import Filter, filter_of  # noqa: F401
from orderlens.llm.shingles import _ODD, mix, per_row, plain_text
from orderlens.llm.tokens import text_slices

PERCENT = 80
#: Cells in which words are counted; the table that tasks get has this size always.
CELLS = 1 << 20
#: Cells whose counts travel in one row.
BLOCK = 256
#: Bytes up to which words are hashed together.
LONG = 64
#: Bytes of text that are split into words together, so that what is made of them stays in a processor's cache.
SLICE = 1 << 20
#: Groups up to this size pair up at once; lines in larger ones name so many earlier lines a round, growing.
CROWD, NEAREST = 512, 8
#: Postings that are paired up together, and twice the pairs of small groups held at once (but for one group).
TOGETHER, AT_ONCE = 1 << 17, 1 << 21
#: Rows of pairs that leave a task together.
SENT = 1 << 14

_LOW = -(2**63)


def _hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches of bytes, eight bytes of all of them at a time; long ones by themselves."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    hashes = lengths.astype(np.uint64)
    live = np.arange(len(lengths))
    for at in range(0, LONG, 8):
        live = live[lengths[live] > at]
        if not len(live):
            return hashes
        left = np.minimum(lengths[live] - at, 8).astype(np.uint64)
        chunk = eights[starts[live] + at] & (~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * left))
        hashes[live] = mix(hashes[live] * _ODD ^ chunk)
    for i in live[lengths[live] > LONG].tolist():
        hashes[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + lengths[i]].tobytes())
    return hashes


def _lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines per text; line and number of each word; and the hashes of the numbered distinct words."""
    texts = plain_text(texts, lines=True)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    breaks = np.flatnonzero(data == 10)
    per_text = np.diff(np.searchsorted(breaks, offsets)) + 1
    inside = (data != 32) & (data != 10)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = np.diff(offsets) > 0  # a word ends with its text
    head, tail = offsets[:-1][full], offsets[1:][full] - 1
    first[head] = inside[head]
    last[tail] = inside[tail]
    starts = np.flatnonzero(first)
    coded = pa.array(_hashes(data, starts, np.flatnonzero(last) + 1 - starts)).dictionary_encode()
    rows = np.searchsorted(breaks, starts) + np.searchsorted(offsets, starts, side="right") - 1
    hashes = coded.dictionary.to_numpy(zero_copy_only=False)
    return per_text, rows, coded.indices.to_numpy(zero_copy_only=False), hashes


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(44)).astype(np.int64)


_SCAN = "class long, doc long, row long, line int, block int, counts binary"


def _distinct(rows: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of row and number (under 2 ** 32), sorted by both."""
    pairs = np.sort((rows.astype(np.int64) << 32) | numbers)
    if len(pairs):
        pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])]
    return pairs >> 32, pairs & 0xFFFFFFFF


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First scan: the class and place of each line, and at the end the words of each cell, in blocks of cells."""
    total = np.zeros(CELLS, np.int64)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def batch_of(*columns) -> pa.RecordBatch:
        n = next(len(c) for c in columns if c is not None)
        arrays = [pa.nulls(n, k) if c is None else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in _SCAN.split(", ")])

    for batch in (part for whole in batches for part in text_slices(whole, size=SLICE)):
        per_text, rows, codes, hashes = _lines(batch.column("text"))
        if not len(hashes):
            continue
        rows, codes = _distinct(rows, codes)
        sizes = np.bincount(rows, minlength=int(per_text.sum()))
        total += np.bincount(_cell(hashes), np.bincount(codes, minlength=len(hashes)), CELLS).astype(np.int64)
        name = _class(mix(hashes)[codes], sizes)
        doc, row, line = _number(batch, per_text)
        full = np.flatnonzero(sizes)
        yield batch_of(name[full], doc[full], row[full], line[full].astype(np.int32), None, None)
    if total.any():
        yield batch_of(None, None, None, None, *_packed(total))


def _packed(total: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Blocks of cells that have words, and of each the counts that are not 0, followed by their places."""
    cells = np.flatnonzero(total)
    blocks, first = np.unique(cells // BLOCK, return_index=True)
    ends = [*first[1:].tolist(), len(cells)]
    counts, places = total[cells], (cells % BLOCK).astype(np.uint8)
    return blocks.astype(np.int32), [counts[a:b].tobytes() + places[a:b].tobytes() for a, b in zip(first.tolist(), ends, strict=True)]


def _unpacked(blocks: pa.Array, packed: pa.Array, total: np.ndarray) -> None:
    """Add the counts of these blocks to ``total``."""
    for block, own in zip(blocks.to_pylist(), packed, strict=True):
        n = len(own.as_buffer()) // 9
        counts = np.frombuffer(own.as_buffer(), np.int64, n)
        total[block * BLOCK + np.frombuffer(own.as_buffer(), np.uint8, n, 8 * n).astype(np.int64)] += counts


def _cell_counts(scanned: DataFrame) -> np.ndarray:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(CELLS, np.int64)
        for batch in batches:
            _unpacked(batch.column("block"), batch.column("counts"), sums)
        if sums.any():
            blocks, packed = _packed(sums)
            yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(packed, pa.binary())], ["block", "counts"])

    blocks = scanned.where("block is not null").select("block", "counts").repartition("block")
    out = np.zeros(CELLS, np.int64)
    got = blocks.mapInArrow(add, "block int, counts binary").toArrow().combine_chunks()  # CELLS numbers at most
    for batch in got.to_batches():
        _unpacked(batch.column("block"), batch.column("counts"), out)
    return out


def _ranks(counts: np.ndarray) -> np.ndarray:
    """Place of each cell's count among the counts, in the upper 24 bits."""
    order = np.unique(counts, return_inverse=True)[1].astype(np.uint64)
    return np.minimum(order, np.uint64(2**24 - 1)) << np.uint64(40)


def line_sets(texts: pa.Array, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines per text; sizes, distinct words as numbers that sort by rarity, and classes of the lines."""
    per_text, rows, codes, hashes = _lines(texts)
    keys = ranks[_cell(hashes)] | (hashes & np.uint64(2**40 - 1)) if len(hashes) else hashes
    keys, first, place = np.unique(keys, return_index=True, return_inverse=True)
    rows, codes = _distinct(rows, place[codes])
    sizes = np.bincount(rows, minlength=int(per_text.sum()))
    return per_text, sizes, keys[codes], _class(mix(hashes[first])[codes], sizes)


def least_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common words that sets of these sizes need at least."""
    return (PERCENT * (a + b) + 99 + PERCENT) // (100 + PERCENT)


def _class(mixed: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return per_row(mixed, sizes, np.add).view(np.int64)


def _number(batch: pa.RecordBatch, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Id and row hash of each line's document, and the line's number in it."""
    ids = pc.fill_null(batch.column("doc_id"), _LOW).to_numpy(zero_copy_only=False)
    rows = batch.column("row").to_numpy(zero_copy_only=False)
    line = np.arange(per_text.sum()) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    return np.repeat(ids, per_text), np.repeat(rows, per_text), line


_POSTING = "word long, class long, doc long, row long, line int, size int, at int, bits1 long, bits2 long"


def _postings(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = sent.value
        for batch in (part for whole in batches for part in text_slices(whole, size=SLICE)):
            per_text, sizes, keys, name = line_sets(batch.column("text"), ranks)
            doc, row, line = _number(batch, per_text)
            # lines of under four words are similar to equal ones only; of equal ones the first is enough
            order = np.lexsort((line, row, doc, name))
            first = np.ones(len(order), bool)
            first[1:] = name[order][1:] != name[order][:-1]
            chosen = np.zeros(len(order), bool)
            chosen[order[first]] = True
            chosen &= sizes >= 4
            prefix = np.where(chosen, sizes - (PERCENT * sizes + 99) // 100 + 1, 0)
            flips = mix(keys)
            half = np.uint64(1) << (flips & np.uint64(63))
            upper = (flips >> np.uint64(6)) & np.uint64(1) == 1
            zero = np.uint64(0)
            bits1 = per_row(np.where(upper, zero, half), sizes, np.bitwise_xor).view(np.int64)
            bits2 = per_row(np.where(upper, half, zero), sizes, np.bitwise_xor).view(np.int64)
            owner = np.repeat(np.arange(len(sizes)), prefix)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(prefix) - prefix, prefix)
            word = keys[(np.cumsum(sizes) - sizes)[owner] + at].view(np.int64)
            columns = [word, *(x[owner] for x in (name, doc, row)), line[owner].astype(np.int32), sizes[owner].astype(np.int32)]
            columns += [at.astype(np.int32), bits1[owner], bits2[owner]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in _POSTING.split(", ")])

    return run


def _near(x: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of places may be similar, and the bits in which they differ."""
    sa, sb = x["size"][a], x["size"][b]
    need = least_common(sa, sb)
    room = np.minimum(sa - x["at"][a], sb - x["at"][b])
    apart = np.bitwise_count(x["bits1"][a] ^ x["bits1"][b]).astype(np.int16) + np.bitwise_count(x["bits2"][a] ^ x["bits2"][b])
    return (room >= need) & (apart <= sa + sb - 2 * need), apart


def _after(x: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a's first line comes after b's."""
    more = (x["doc"][a] > x["doc"][b]) | ((x["doc"][a] == x["doc"][b]) & (x["row"][a] > x["row"][b]))
    same = (x["doc"][a] == x["doc"][b]) & (x["row"][a] == x["row"][b])
    return more | (same & (x["line"][a] > x["line"][b]))


def _small_groups(x: dict[str, np.ndarray], place: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """All pairs (later, earlier, differing bits) that may be similar; places stand by word and size."""
    later, earlier, bits = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int16)]
    d = 0
    while len(place):
        d += 1
        live = place + d < ends
        place, ends = place[live], ends[live]
        live = 100 * x["size"][place] >= PERCENT * x["size"][place + d]
        place, ends = place[live], ends[live]
        good, apart = _near(x, place, place + d)
        a, b = place[good], place[good] + d
        swap = _after(x, a, b)
        later.append(np.where(swap, a, b))
        earlier.append(np.where(swap, b, a))
        bits.append(apart[good])
    return np.concatenate(later), np.concatenate(earlier), np.concatenate(bits)


def _large_group(x: dict[str, np.ndarray], start: int, end: int, skip: int, take: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The same for one large group, some rows against all at a time; only the pairs that _nearest may keep."""
    step = max(1, min(128, AT_ONCE // 8 // (end - start)))
    for low in range(start, end, step):
        rows = np.arange(low, min(low + step, end))
        rows = rows[x["wanted"][rows]]
        if not len(rows):
            continue
        a, b = (v.ravel() for v in np.broadcast_arrays(rows[:, None], np.arange(start, end)[None, :]))
        good, apart = _near(x, a, b)
        a, b, apart = a[good], b[good], apart[good]
        keep = (a != b) & _after(x, a, b)
        yield _nearest(a[keep], b[keep], apart[keep], skip, take)


def _nearest(later: np.ndarray, earlier: np.ndarray, apart: np.ndarray, skip: int, take: int) -> tuple[np.ndarray, ...]:
    """Of each later line's pairs those from ``skip`` on by distance, and the lines that have still more."""
    order = np.lexsort((earlier, apart, later))
    later, earlier = later[order], earlier[order]
    starts = np.flatnonzero(np.concatenate([[True], later[1:] != later[:-1]])) if len(later) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(starts, len(later)))
    rank = np.arange(len(later)) - np.repeat(starts, lengths)
    chosen = (rank >= skip) & (rank < skip + take)
    return later[chosen], earlier[chosen], later[starts[lengths > skip + take]]


_PAIRS = "later long, earlier long, later_doc long, earlier_doc long, " + _POSTING
_NAMES = [c.split()[0] for c in _POSTING.split(", ")]


def _pairs(skip: int, take: int, first: bool):
    """Pairs of classes from sorted postings; the rows of crowded groups follow when more pairs are left in them."""

    def batch_of(x: dict[str, np.ndarray], later: np.ndarray, earlier: np.ndarray, again: np.ndarray) -> pa.RecordBatch:
        n, m = len(later), len(again)
        out = [pa.concat_arrays([pa.array(x[k][v], pa.int64()), pa.nulls(m, pa.int64())]) for k in ("class", "doc") for v in (later, earlier)]
        for k in _NAMES:
            column = pa.array((x[k].view(np.int64) if x[k].dtype == np.uint64 else x[k])[again])
            out.append(pa.concat_arrays([pa.nulls(n, column.type), column]))
        return pa.RecordBatch.from_arrays(out, ["later", "earlier", "later_doc", "earlier_doc", *_NAMES])

    def groups(x: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        # a line alone under its word meets nobody; the others stand by size, equal lines together, the first one first
        same = np.concatenate([[False], x["word"][1:] == x["word"][:-1], [False]])
        x = {k: v[same[1:] | same[:-1]] for k, v in x.items()}
        group = np.cumsum(np.concatenate([[False], x["word"][1:] != x["word"][:-1]])[: len(x["word"])])
        order = np.lexsort((x["line"], x["row"], x["doc"], x["class"], group << 32 | x["size"]))
        x = {k: v[order] for k, v in x.items()}
        new = np.ones(len(x["word"]), bool)
        new[1:] = (x["word"][1:] != x["word"][:-1]) | (x["class"][1:] != x["class"][:-1])
        x = {k: v[new] for k, v in x.items()}
        x |= {k: x[k].view(np.uint64) for k in ("bits1", "bits2")}
        starts = np.flatnonzero(np.concatenate([[True], x["word"][1:] != x["word"][:-1]]))
        lengths = np.diff(np.append(starts, len(x["word"])))
        none = np.zeros(0, np.int64)
        crowds = [none]
        for later, earlier, crowd in found(x, starts, lengths):
            crowds.append(crowd)
            for i in range(0, len(later), SENT):
                yield batch_of(x, later[i : i + SENT], earlier[i : i + SENT], none)
        for g in np.unique(np.concatenate(crowds)).tolist():
            for i in range(starts[g], starts[g] + lengths[g], SENT):
                yield batch_of(x, none, none, np.arange(i, min(i + SENT, starts[g] + lengths[g])))

    def found(x: dict[str, np.ndarray], starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Some pairs at a time, and the groups in which more are left."""
        if first:
            small = np.flatnonzero((lengths > 1) & (lengths <= CROWD))
            load = np.cumsum(lengths[small] ** 2) // AT_ONCE
            for some in np.split(small, np.flatnonzero(load[1:] != load[:-1]) + 1):
                place = np.arange(lengths[some].sum()) + np.repeat(starts[some] - np.cumsum(lengths[some]) + lengths[some], lengths[some])
                a, b, more = _nearest(*_small_groups(x, place, np.repeat(starts[some] + lengths[some], lengths[some])), skip, take)
                yield a, b, np.unique(np.searchsorted(starts, more, side="right") - 1)
        for g in np.flatnonzero(lengths > (CROWD if first else 1)).tolist():
            for a, b, more in _large_group(x, starts[g], starts[g] + lengths[g], skip, take):
                yield a, b, np.array([g][: len(more)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        rows = 0
        for batch in batches:
            x = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in batch.schema.names}
            x.setdefault("wanted", np.ones(len(batch), bool))
            if not len(batch):
                continue
            held.append(x)
            rows += len(batch)
            if rows < TOGETHER or held[0]["word"][0] == x["word"][-1]:  # one word only, which may go on
                continue
            whole = {k: np.concatenate([h[k] for h in held]) for k in x}
            cut = int(np.searchsorted(whole["word"], whole["word"][-1], side="left"))  # the last word may go on
            held, rows = [{k: v[cut:].copy() for k, v in whole.items()}], len(whole["word"]) - cut
            yield from groups({k: v[:cut] for k, v in whole.items()})
        if held:
            yield from groups({k: np.concatenate([h[k] for h in held]) for k in held[0]})

    return run


def _by_word(postings: DataFrame) -> DataFrame:
    return postings.repartition("word").sortWithinPartitions("word")


def _sets(sent_ranks, sent_docs, sent_classes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pc.fill_null(batch.column("doc_id"), _LOW).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(sent_docs.value.has(ids)))
            for part in text_slices(batch, size=SLICE):
                _, sizes, keys, name = line_sets(part.column("text"), sent_ranks.value)
                keep = np.unique(name, return_index=True)[1]
                keep = keep[sent_classes.value.has(name[keep]) & (sizes[keep] >= 4)]
                ends = np.cumsum(sizes)
                sets = [keys[ends[i] - sizes[i] : ends[i]].tobytes() for i in keep.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(name[keep]), pa.array(sets, pa.binary())], ["class", "words"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        column = column.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        words = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        return np.ascontiguousarray(words).view(np.uint64), np.diff(offsets) // 8

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, len(batch), 4096)):
                (x, nx), (y, ny) = flat(part.column("left")), flat(part.column("right"))
                numbers = np.unique(np.concatenate([x, y]), return_inverse=True)[1]
                pair = np.concatenate([np.repeat(np.arange(len(part)), nx), np.repeat(np.arange(len(part)), ny)])
                both = np.sort((pair << 32) | numbers)  # a word of both sets comes twice
                common = np.bincount(both[1:][both[1:] == both[:-1]] >> 32, minlength=len(part))
                yield part.select(["later"]).filter(pa.array(common >= least_common(nx, ny)))

    one = sets.select(F.col("class").alias("later"), F.col("words").alias("left"))
    two = sets.select(F.col("class").alias("earlier"), F.col("words").alias("right"))
    return pairs.join(one, "later").join(two, "earlier").select("later", "left", "right").mapInArrow(check, "later long").distinct()


def similar_to_earlier(docs: DataFrame, ranks) -> DataFrame:
    """Classes (equal sets) that have an earlier similar line of another class."""
    with scratch(docs.sparkSession):
        return stage(_matched(docs, ranks), "similar", result=True)


def _matched(docs: DataFrame, ranks) -> DataFrame:
    spark = docs.sparkSession
    columns = ["later", "earlier", "later_doc", "earlier_doc"]
    postings = docs.mapInArrow(_postings(ranks), _POSTING)
    found = stage(_by_word(postings).mapInArrow(_pairs(0, NEAREST, True), _PAIRS), "pairs")
    crowded = found.where("later is null").drop(*columns)
    pairs = stage(found.where("later is not null").select(*columns).distinct(), "candidates")
    matched, skip, take = None, 0, NEAREST
    while True:
        sides = [pairs.select(F.col(s).alias("class"), F.col(f"{s}_doc").alias("doc")) for s in ("later", "earlier")]
        sides = sides[0].unionAll(sides[1]).distinct()
        classes = spark.sparkContext.broadcast(filter_of(sides.select("class").distinct()))  # FILTER_BYTES at most
        holding = spark.sparkContext.broadcast(filter_of(sides.select("doc").distinct()))
        sets = docs.mapInArrow(_sets(ranks, holding, classes), "class long, words binary").dropDuplicates(["class"])
        good = stage(_verified(pairs, stage(sets, "sets")), "matched")
        matched = good if matched is None else matched.unionAll(good)
        skip, take = skip + take, take * 8
        known = matched.select(F.col("later").alias("class")).distinct().withColumn("done", F.lit(True))
        left = crowded.join(known, "class", "left").withColumn("wanted", F.col("done").isNull()).drop("done")
        more = _by_word(left).mapInArrow(_pairs(skip, take, False), _PAIRS).where("later is not null")
        pairs = stage(more.select(*columns).distinct(), "candidates")
        if not pairs.head(1):
            return matched.select(F.col("later").alias("class")).distinct()


def remove_lines(docs: DataFrame) -> DataFrame:
    """All rows: doc_id, text without the removed lines, n_lines, n_removed; and ``rest``, the columns given."""
    spark = docs.sparkSession
    ship(spark)
    docs_columns = docs.columns
    given = with_rest(docs).withColumns({"row": F.xxhash64("text"), "doc": F.coalesce("doc_id", F.lit(_LOW))})
    docs = given.select("doc_id", "text", "row")
    scanned = stage(docs.mapInArrow(_scan, _SCAN), "lines")
    ranks = spark.sparkContext.broadcast(_ranks(_cell_counts(scanned)))  # CELLS numbers
    similar = similar_to_earlier(docs, ranks)
    place = F.struct("doc", "row", "line")
    firsts = scanned.where("block is null").groupBy("class").agg(F.min(place).alias("first"))
    stay = firsts.join(similar, "class", "left_anti").select("first.*")
    stay = stay.groupBy("doc", "row").agg(F.collect_list("line").alias("stay"))
    at = docs_columns.index("text")
    joined = given.drop("doc_id", "text").join(stay, ["doc", "row"], "left").select("stay", "rest")
    kinds = joined.schema["rest"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, removed = [], [], []
            own_texts = batch.column("rest").field(at).to_pylist()
            for text, stay in zip(own_texts, batch.column("stay").to_pylist(), strict=True):
                own = text.split("\n") if text is not None else []
                kept = set(stay or ())
                left = own if len(kept) == len(own) else [s for i, s in enumerate(own) if i in kept or not s.strip(" \t\n\r\x0b\x0c")]
                texts.append("\n".join(left) if len(left) < len(own) else None)
                total.append(len(own))
                removed.append(len(own) - len(left))
            numbers = [pa.array(x, pa.int64()) for x in (total, removed)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()), *numbers, batch.column("rest")], ["text", "n_lines", "n_removed", "rest"]
            )

    found = joined.mapInArrow(cut, f"text string, n_lines long, n_removed long, rest {kinds}")
    text = F.when(F.col("n_removed") > 0, F.col("text")).otherwise(F.col(f"rest.c{at}")).alias("text")
    return found.select(F.col(f"rest.c{docs_columns.index('doc_id')}").alias("doc_id"), text, "n_lines", "n_removed", "rest")
