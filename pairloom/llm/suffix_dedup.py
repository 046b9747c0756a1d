"""Exact removal of repeated byte strings through range-partitioned, sorted suffixes.

A string of LENGTH bytes (a window) can recur only if its anchor does: the first of its 32-byte strings with
the smallest hash, which its content alone decides. Successive windows share an anchor; such a run of
windows is one block of text. So hashes of anchors are counted first, and only blocks whose anchor
recurs go on. Blocks with equal bytes are one, its first; the later ones are removed whole. Of the
first ones, those whose anchor has several blocks become suffixes: the text from the anchor on, with
the bytes before it. Spark's sampled splitters range-partition the suffixes by their leading bytes; each
bucket sorts them by multikey quicksort, and what they share with their neighbours on the right and
on the left says which windows are equal. Windows that a bucket's first or last suffix may share
with another bucket are compared across buckets.

Places are ordered by one number: the document's id, 31 bits of its text's hash, and the byte's place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import bounded_batches, byte_text, joined_small, sliced, spread_join, stored

#: Bytes of an anchor, and of a text that are worked on at once.
ANCHOR, PIECE = 32, 1 << 19
#: Suffixes of a bucket, and how many of them are sorted by all their words at once.
BUCKET_ROWS, SMALL = 100_000, 2048
#: An anchor of more suffixes is dealt over several buckets.
ANCHOR_ROWS = BUCKET_ROWS // 8
#: Bits of a filter for each entry, and at most; a full filter lets all rows pass, and later steps decide.
BITS_PER_ENTRY, MOST_BITS, CHUNK = 16, 1 << 28, 1 << 16
KEY = "decimal(38,0)"
KEY_TYPE = pa.decimal128(38, 0)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers, in place."""
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def anchor_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of each string of ANCHOR bytes of ``data``, which has that many at least."""
    padded = np.concatenate([data, np.zeros(7, np.uint8)])
    out = mixed(np.ndarray(len(data) - 7, "<u8", padded, strides=(1,)) + np.uint64(1))
    size = 8
    while size < ANCHOR:
        out = mixed(out[:-size] * np.uint64(0xA0761D6478BD642F) + out[size:])
        size *= 2
    return out


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` successive values."""
    out, size = values, 1
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


@dataclass
class Blocks:
    """Runs of windows that share an anchor: places of their first windows, of their anchors, and ends of windows' places."""

    data: np.ndarray
    owner: np.ndarray
    origin: np.ndarray
    start: np.ndarray
    end: np.ndarray
    anchor: np.ndarray
    hash: np.ndarray
    content: np.ndarray

    def taken(self, mask: np.ndarray) -> Blocks:
        rows = (self.owner, self.origin, self.start, self.end, self.anchor, self.hash, self.content)
        return Blocks(self.data, *[x[mask] for x in rows])


def blocks_of(texts: list[memoryview], length: int) -> Iterator[Blocks]:
    """The blocks of ``texts``, some pieces at a time; ``owner`` is a text's number, ``origin`` what to subtract for a place in it."""
    held, size = [], 0
    for n, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, PIECE):
            piece = np.frombuffer(text[at: at + PIECE + length - 1], np.uint8)
            held.append((n, at, piece))
            size += len(piece)
            if size >= PIECE:
                yield blocks_of_pieces(held, length)
                held, size = [], 0
    if held:
        yield blocks_of_pieces(held, length)


def blocks_of_pieces(pieces: list[tuple[int, int, np.ndarray]], length: int) -> Blocks:
    data = np.concatenate([x for _, _, x in pieces])
    sizes = np.array([len(x) for _, _, x in pieces])
    begin = np.cumsum(sizes) - sizes
    hashes = anchor_hashes(data)
    low = least(hashes, length - ANCHOR + 1)
    # A window at its piece's end would go beyond it.
    valid = np.ones(len(low), bool)
    fresh = np.zeros(len(low), bool)
    fresh[0] = True
    for first, size in zip(begin.tolist(), sizes.tolist()):
        valid[first + size - length + 1: first + size] = False
        fresh[first] = True
    gone = hashes[: len(low)] == low
    fresh[1:] |= (low[1:] != low[:-1]) | gone[:-1] | (valid[1:] != valid[:-1])
    place = np.flatnonzero(fresh)
    end = np.append(place[1:], len(low))
    keep = valid[place]
    start, end = place[keep], end[keep]
    last = end - 1
    anchor = last.copy()
    # Where the run doesn't end with its anchor, the anchor is the first least hash of its last window.
    open_ = np.flatnonzero(~gone[last])
    for at in range(0, len(open_), 1 << 14):
        rows = open_[at: at + (1 << 14)]
        near = hashes[last[rows, None] + np.arange(length - ANCHOR + 1)]
        anchor[rows] += (near == low[last[rows], None]).argmax(1)
    owner_piece = np.searchsorted(begin, start, "right") - 1
    content = (end - start).astype(np.uint64)
    for step in range(0, 2 * length - ANCHOR, ANCHOR):
        content = mixed(content * np.uint64(0xE7037ED1A0B428DB) + hashes[np.minimum(start + step, last + length - ANCHOR)])
    origin = (begin - np.array([at for _, at, _ in pieces]))[owner_piece]
    owner = np.array([n for n, _, _ in pieces])[owner_piece]
    return Blocks(data, owner, origin, start, end, anchor, low[start], content)


def keys_of(ids: pa.Array, ties: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower and upper 64 bits of places' numbers; a null id comes after all others."""
    null = np.asarray(ids.is_null())[owner]
    own = np.asarray(ids.fill_null(0)).astype(np.int64)[owner]
    high = np.where(null, np.int64(1) << 61, own >> 2)
    low = (np.where(null, 0, own & 3).astype(np.uint64) << np.uint64(62)) | (ties[owner].astype(np.uint64) << np.uint64(31)) | place.astype(np.uint64)
    return low, high


def as_decimals(low: np.ndarray, high: np.ndarray) -> pa.Array:
    both = np.empty((len(low), 2), np.uint64)
    both[:, 0], both[:, 1] = low, high.view(np.uint64)
    return pa.Array.from_buffers(KEY_TYPE, len(low), [None, pa.py_buffer(both.tobytes())])


def from_decimals(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lower and upper 64 bits of a column of whole numbers."""
    both = np.frombuffer(keys.buffers()[1], np.uint64)[2 * keys.offset: 2 * (keys.offset + len(keys))].reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy().view(np.int64)


@dataclass
class Filter:
    """A bit for each hash of a set, modulo its size: what isn't marked isn't in the set."""

    words: np.ndarray

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & np.uint64(64 * len(self.words) - 1)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def filter_of(hashes: DataFrame) -> Filter:
    """The filter of the stored column ``hash``; the driver gets its bits, MOST_BITS at most, whatever the table's size."""
    bits = CHUNK
    n = hashes.count()
    while bits < min(BITS_PER_ENTRY * n, MOST_BITS):
        bits *= 2

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, np.ndarray] = {}
        for batch in batches:
            at = np.asarray(batch.column(0)) & (bits - 1)
            at.sort()
            own, begin = np.unique(at // CHUNK, return_index=True)
            for chunk, places in zip(own.tolist(), np.split(at % CHUNK, begin[1:])):
                chunks.setdefault(chunk, np.zeros(CHUNK, bool))[places] = True
        packed = [np.packbits(x, bitorder="little").tobytes() for x in chunks.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(chunks), pa.int64()), pa.array(packed, pa.binary())], ["chunk", "bits"])

    by_chunk = hashes.select("hash").repartition(F.shiftright(F.col("hash").bitwiseAND(F.lit(bits - 1)), CHUNK.bit_length() - 1))
    words = np.zeros(bits // 64, np.uint64)
    for r in by_chunk.mapInArrow(mark, "chunk long, bits binary").toLocalIterator():
        words[r["chunk"] * CHUNK // 64: (r["chunk"] + 1) * CHUNK // 64] = np.frombuffer(r["bits"], "<u8")
    return Filter(words)


def key_hash(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return mixed(low + high.view(np.uint64) * np.uint64(0xA0761D6478BD642F))


def document_tie() -> Column:
    """31 bits of a text's hash, which order the rows that repeat an id."""
    return F.xxhash64(byte_text()).bitwiseAND((1 << 31) - 1)


def on_blocks(docs: DataFrame, length: int, schema: str, of) -> DataFrame:
    """``of(blocks, keys)`` for the blocks of all texts; keys(owner, place) gives places' numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, ties = batch.column(0), np.asarray(batch.column(1))
            texts = [memoryview(x.as_buffer()) for x in batch.column(2)]
            for blocks in blocks_of(texts, length):
                yield of(blocks, lambda owner, place: keys_of(ids, ties, owner, place))  # noqa: B023

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), document_tie().alias("tie"), byte_text().alias("data")).mapInArrow(run, schema)


def anchor_counts(docs: DataFrame, length: int) -> DataFrame:
    """(hash, n): how many blocks each anchor has."""

    def of(blocks: Blocks, keys) -> pa.RecordBatch:
        found, n = np.unique(blocks.hash, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["hash", "n"])

    return on_blocks(docs, length, "hash long, n long", of).groupBy("hash").agg(F.sum("n").alias("n"))


def repeated_blocks(docs: DataFrame, length: int, recurring: Filter) -> DataFrame:
    """(hash, content, key, n) of the blocks whose anchor ``recurring`` has: hashes, first window, number of windows."""
    shared = docs.sparkSession.sparkContext.broadcast(recurring)

    def of(blocks: Blocks, keys) -> pa.RecordBatch:
        few = blocks.taken(shared.value.has(blocks.hash))
        key = as_decimals(*keys(few.owner, few.start - few.origin))
        columns = [pa.array(few.hash.view(np.int64)), pa.array(few.content.view(np.int64)), key, pa.array((few.end - few.start).astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, ["hash", "content", "key", "n"])

    return on_blocks(docs, length, f"hash long, content long, key {KEY}, n int", of)


def anchor_suffixes(docs: DataFrame, length: int, wanted: Filter) -> DataFrame:
    """(suffix, before, key): of the blocks whose first window ``wanted`` has, the bytes from the anchor on, those before it backwards, the anchor's number.

    A window that begins o bytes before the anchor is the first o bytes of ``before`` and the first length - o of ``suffix``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def of(blocks: Blocks, keys) -> pa.RecordBatch:
        few = blocks.taken(shared.value.has(key_hash(*keys(blocks.owner, blocks.start - blocks.origin))))
        rows = list(zip(few.start.tolist(), few.anchor.tolist(), (few.end + length - 1).tolist()))
        whole = few.data.tobytes()
        columns = [pa.array([whole[a:e] for _, a, e in rows], pa.binary()), pa.array([whole[s:a][::-1] for s, a, _ in rows], pa.binary())]
        return pa.RecordBatch.from_arrays([*columns, as_decimals(*keys(few.owner, few.anchor - few.origin))], ["suffix", "before", "key"])

    return on_blocks(docs, length, f"suffix binary, before binary, key {KEY}", of)


def padded(values: list[bytes], size: int) -> np.ndarray:
    """The strings as rows of ``size`` bytes, a multiple of 8, filled with zeros."""
    return np.frombuffer(b"".join(x.ljust(size, b"\0") for x in values), np.uint8).reshape(-1, size)


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """The order of rows of big-endian 8-byte words.

    A part is split at the median of its rows' next word; the rows that have that word go on
    with the word after it. Parts of SMALL rows are sorted by all that is left.
    """
    order = np.arange(len(words))
    todo = [(0, len(words), 0)]
    while todo:
        low, high, depth = todo.pop()
        if high - low < 2 or depth == words.shape[1]:
            continue
        own = order[low:high]
        if len(own) <= SMALL:
            order[low:high] = own[np.lexsort(words[own, depth:].T[::-1])]
            continue
        word = words[own, depth]
        pivot = np.partition(word, len(word) // 2)[len(word) // 2]
        less, equal, more = own[word < pivot], own[word == pivot], own[word > pivot]
        order[low:high] = np.concatenate([less, equal, more])
        first, second = low + len(less), low + len(less) + len(equal)
        todo += [(low, first, depth), (first, second, depth + 1), (second, high, depth)]
    return order


def sorted_strings(values: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of ``values`` and how many bytes each shares with the one before it; the first shares -1."""
    rows = padded(values, size)
    order = multikey_quicksort(rows.view(">u8").astype(np.uint64))
    rows = rows[order]
    shared = np.full(len(rows), size)
    differ = rows[1:] != rows[:-1]
    shared[1:] = np.where(differ.any(1), differ.argmax(1), size)
    shared[0] = -1
    return order, shared


def bucket_repeats(suffixes: list[bytes], befores: list[bytes], keys: np.ndarray, hot: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(o, later, ends) for each distance o of windows from their anchors.

    ``later`` are the places of suffixes whose window isn't its bucket's first of those equal to it,
    ``ends`` those of first ones whose equals may be in another bucket, too, as their anchor is ``hot`` and they
    share the bucket's first or last suffix's bytes. ``keys`` are ranks of the anchors' numbers.
    """
    n, most = len(suffixes), length - ANCHOR
    order, shared = sorted_strings(suffixes, -(-length // 8) * 8)
    back, shared_back = sorted_strings(befores, -(-(most + 1) // 8) * 8)
    shortest, longest = length - np.array([len(x) for x in suffixes]), np.array([len(x) for x in befores])
    group, own = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(most + 1):
        rows = np.flatnonzero((shortest <= o) & (o <= longest))
        if not len(rows):
            continue
        number = np.cumsum(shared < length - o) - 1
        group[order], own[back] = number, np.cumsum(shared_back < o) - 1
        pair = group[rows] * n + own[rows]
        sort = np.lexsort((keys[rows], pair))
        rows, pair = rows[sort], pair[sort]
        # Rows of equal numbers are one place, which a filter let pass twice.
        first = np.append(True, pair[1:] != pair[:-1])
        begin = np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
        later = keys[rows] > keys[rows[begin]]
        ends = first & hot[rows] & ((group[rows] == 0) | (group[rows] == number[-1]))
        yield o, rows[later], rows[ends]


def in_buckets(suffixes: DataFrame) -> DataFrame:
    """The stored ``suffixes`` with column hot, dealt by Spark's sampled splitters over buckets of BUCKET_ROWS.

    Suffixes of an anchor share a bucket, unless there are over ANCHOR_ROWS of them (hot): those are dealt by all their bytes.
    """
    anchor = F.substring("suffix", 1, ANCHOR)
    large = suffixes.groupBy(anchor.alias("anchor")).agg(F.count("*").alias("rows")).where(F.col("rows") > ANCHOR_ROWS)
    # At most one for each ANCHOR_ROWS rows.
    large = stored(large.select("anchor", F.lit(True).alias("hot")), "suffix-hot")
    named = joined_small(suffixes.withColumn("anchor", anchor), large, "anchor", "left").withColumn("hot", F.col("hot").isNotNull())
    named = named.withColumns({"more": F.when(F.col("hot"), F.col("suffix")), "back": F.when(F.col("hot"), F.col("before"))})
    dealt = named.repartitionByRange(1 + suffixes.count() // BUCKET_ROWS, "anchor", "more", "back")
    return dealt.select("suffix", "before", "key", "hot")


def bucket_spans(suffixes: DataFrame, length: int) -> DataFrame:
    """(key, n, one, two) of the spans of windows that begin again within their bucket, or (one, two not null) windows to be compared across buckets.

    ``suffixes`` is dealt by :func:`in_buckets`; a bucket is a partition.
    """
    names = ["key", "n", "one", "two"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b for b in batches if b.num_rows]
        if not own:
            return
        table = pa.Table.from_batches(own).combine_chunks()
        suffix, before = table.column("suffix").to_pylist(), table.column("before").to_pylist()
        low, high = from_decimals(table.column("key").combine_chunks())
        hot = np.asarray(table.column("hot").combine_chunks().cast(pa.int8())).astype(bool)
        del table, own
        rank = np.empty(len(low), np.int64)
        sort = np.lexsort((low, high))
        step = np.append(False, (low[sort][1:] != low[sort][:-1]) | (high[sort][1:] != high[sort][:-1]))
        rank[sort] = np.cumsum(step)
        flags = np.zeros((len(low), length - ANCHOR + 3), bool)
        for o, later, ends in bucket_repeats(suffix, before, rank, hot, length):
            flags[later, length - ANCHOR + 1 - o] = True
            if len(ends):
                hashes = [xxhash.xxh3_128_intdigest(before[i][:o][::-1] + suffix[i][: length - o]) for i in ends.tolist()]
                one = np.array([x >> 64 for x in hashes], np.uint64).view(np.int64)
                two = np.array([x & (2**64 - 1) for x in hashes], np.uint64).view(np.int64)
                key = as_decimals(low[ends] - np.uint64(o), high[ends])
                yield pa.RecordBatch.from_arrays([key, pa.array(np.full(len(ends), length, np.int32)), pa.array(one), pa.array(two)], names)
        # Windows that follow one another make one span.
        change = np.diff(flags.astype(np.int8), axis=1)
        row, begin = np.nonzero(change == 1)
        end = np.nonzero(change == -1)[1]
        none = pa.nulls(len(row), pa.int64())
        key = as_decimals(low[row] - (length - ANCHOR - begin).astype(np.uint64), high[row])
        yield pa.RecordBatch.from_arrays([key, pa.array((end - begin + length - 1).astype(np.int32)), none, none], names)

    return suffixes.mapInArrow(of, f"key {KEY}, n int, one long, two long")


def located(spans: DataFrame) -> DataFrame:
    """(doc_id, tie, start, end) of spans (key, n)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high = from_decimals(batch.column(0))
            null = high == np.int64(1) << 61
            doc = (high << np.int64(2)) | (low >> np.uint64(62)).astype(np.int64)
            tie = (low >> np.uint64(31)) & np.uint64((1 << 31) - 1)
            start = (low & np.uint64((1 << 31) - 1)).astype(np.int64)
            columns = [pa.array(doc, mask=null), pa.array(tie.astype(np.int64)), pa.array(start), pa.array(start + np.asarray(batch.column(1)))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tie", "start", "end"])

    return spans.select("key", "n").mapInArrow(of, "doc_id long, tie long, start long, end long")


def repeated_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, tie, start, end): byte spans, which may overlap, that cover what :func:`without_repeats` removes.

    Rows equal in id and text have the same spans, those of the first of them.
    """
    if length < ANCHOR:
        raise ValueError(f"strings of under {ANCHOR} bytes have no anchor")
    counts = stored(anchor_counts(docs, length).where("n > 1").select("hash"), "suffix-anchors")
    repeated = stored(repeated_blocks(docs, length, filter_of(counts)), "suffix-blocks")
    first = stored(repeated.groupBy("hash", "content").agg(F.min("key").alias("first"), F.count("*").alias("copies")), "suffix-first")
    copies = spread_join(repeated, first.where("copies > 1").select("hash", "content", "first"), ["hash", "content"], F.col("key"))
    whole = copies.where("key > first").select("key", (F.col("n") + (length - 1)).alias("n"))

    several = stored(first.groupBy("hash").agg(F.count("*").alias("blocks")).where("blocks > 1").select("hash"), "suffix-several")
    heads = spread_join(first, several, "hash", F.col("content")).select("first")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(key_hash(*from_decimals(batch.column(0))).view(np.int64))], ["hash"])

    wanted = filter_of(stored(heads.mapInArrow(hashed, "hash long"), "suffix-heads"))
    # What the filter let pass beside the first blocks are copies, later places of the same bytes.
    found = anchor_suffixes(docs, length, wanted).groupBy("suffix", "before").agg(F.min("key").alias("key"))
    suffixes = stored(found, "suffixes")
    spans = stored(bucket_spans(in_buckets(suffixes), length), "suffix-spans")
    across = spans.where("one IS NOT NULL").withColumn("first", F.min("key").over(Window.partitionBy("one", "two")))
    parts = spans.where("one IS NULL").select("key", "n").union(across.where("key > first").select("key", "n")).union(whole)
    return located(parts)


def without_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans) of each row: its text's bytes without those of repeated strings.

    Removed is every byte that a string of ``length`` bytes covers which also begins earlier, in a row of smaller
    doc_id or before it in the same row; strings are judged on the input and never cross rows. A null text is
    empty. A null id comes after all others. Rows that share an id are documents of their own, in the order of
    their texts' hashes; of rows equal in both, one comes first and the others are removed. ``n_spans``
    counts the maximal removed runs. Texts under ``length`` bytes stay whole. Other columns are
    ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), byte_text().alias("data"), document_tie().alias("tie"))
    # Null ids can be joined on, too.
    named = [F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), "tie"]
    spans = repeated_spans(docs, length).groupBy(*named).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    again = stored(rows.groupBy(*named).agg(F.count("*").alias("n")).where("n > 1").drop("n").withColumn("again", F.lit(True)), "suffix-rows")
    own = rows.select("doc_id", "data", *named).join(spans.hint("shuffle_hash"), ["_id", "_none", "tie"], "left")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out: dict[str, list] = {"kept": [], "n_bytes": [], "n_removed": [], "n_spans": []}
            for text, spans in zip(batch.column(1), batch.column(5)):
                data, runs = text.as_buffer(), merged(spans)
                left, at = [], 0
                for start, end in runs:
                    left.append(data[at:start])
                    at = end
                kept = b"".join([*left, data[at:]])
                for name, value in zip(out, (kept, len(data), len(data) - len(kept), len(runs))):
                    out[name].append(value)
            names = ["doc_id", "_id", "_none", "tie"]
            columns = [batch.column(0), *batch.columns[2:5], pa.array(out["kept"], pa.binary()), *[pa.array(out[c], pa.int64()) for c in list(out)[1:]]]
            yield pa.RecordBatch.from_arrays(columns, [*names, *out])

    schema = "doc_id long, _id long, _none boolean, tie long, kept binary, n_bytes long, n_removed long, n_spans long"
    cut = own.select("doc_id", "data", "_id", "_none", "tie", "spans").mapInArrow(of, schema)
    shown = ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"]
    if not again.limit(1).count():
        return cut.select(*shown)
    cut = joined_small(cut, again, ["_id", "_none", "tie"], "left")
    twice = F.col("again").isNotNull() & (F.col("n_bytes") >= length)
    numbered = cut.where(twice).withColumn("_row", F.row_number().over(Window.partitionBy("_id", "_none", "tie").orderBy("n_bytes")))
    later = F.col("_row") > 1
    judged = numbered.select(
        "doc_id", F.when(later, F.lit(b"")).otherwise(F.col("kept")).alias("kept"), "n_bytes",
        F.when(later, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(later, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
    )
    return cut.where(~twice).select(*shown).union(judged)


def merged(spans: pa.Scalar) -> list[tuple[int, int]]:
    """The maximal runs that a list of spans covers."""
    if not spans.is_valid or not len(spans):
        return []
    fields = spans.values.flatten()
    start, end = np.asarray(fields[0]), np.asarray(fields[1])
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    fresh = np.append(True, start[1:] > reach[:-1])
    return list(zip(start[fresh].tolist(), reach[np.append(fresh[1:], True)].tolist()))


def repeat_digests(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of :func:`without_repeats`."""
    digest = F.sha2("kept", 256).alias("kept_sha256")
    return without_repeats(docs, length).select("doc_id", "n_bytes", "n_removed", "n_spans", digest)
