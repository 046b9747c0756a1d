"""LM scoring by a hierarchical Pitman-Yor model of words after words and of their spelling.

A token is drawn from the restaurant of the word before it. All these restaurants share a parent,
that of words without context, which seats their tables as its customers. A new table's dish there
is spelled out: each byte comes from the restaurant of its two preceding bytes, which shares its
parent, that of one preceding byte, with all contexts of the same end; that parent's parent is
the restaurant without context, and its base is uniform. The tables of the words' restaurant are the
customers of the spelling restaurants. So every text has a probability, known words or not.

Seatings are sampled by Gibbs: each dish's customers are taken out and seated again given all
others. The restaurants of one level are seated side by side, given the tables that the others had
before the sweep. Predictive probabilities are averaged over the seatings after the burn-in.

Pairs of words are dealt by hash into shards of a bounded number of tokens, packed as arrays, so a
sweep reads each shard once; only sums by word travel between shards and words.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.storage import discard
from pairloom.llm.common import bounded_batches, byte_text, crc_of_id, sliced, stored

#: 256 bytes and the end of a word; START stands for the place before a word.
END, START, SYMBOLS = 256, 257, 258
#: Text bytes of a block of documents, and training tokens of a shard of pairs.
BLOCK_BYTES, SHARD_TOKENS = 32_000_000, 4_000_000
MASK = (1 << 32) - 1
#: Words' rows that are packed for their blocks at once.
PACKED_ROWS = 300_000
#: Customers of a dish up to which the Stirling numbers are tabulated.
EXACT = 1024
STRENGTH = 1.0


@lru_cache(8)
def stirling_logs(discount: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of generalised Stirling numbers: [c, t] counts seatings of c customers at t tables."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(most):
        t = np.arange(1, c + 2)
        stay = np.where(t <= c, np.log(np.maximum(c - discount * t, 1e-300)) + out[c, t], -np.inf)
        out[c + 1, t] = np.logaddexp(out[c, t - 1], stay)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """64 well mixed bits of each number."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def draws(dish: np.ndarray, seed: int, turn: int) -> np.ndarray:
    """A number in [0, 1) for each dish, by its name, the sweep's seed and the turn only: whatever stands beside it."""
    salt = mixed(np.array([seed * 1_000_003 + turn + 1], np.uint64))[0]
    return (mixed(dish.view(np.uint64) ^ salt) >> np.uint64(11)).astype(float) / (1 << 53)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function of positive numbers, by Stirling's series from 8 on."""
    x, shift = np.array(x, float), np.zeros(np.shape(x))
    while (low := x < 8).any():
        shift = np.where(low, shift - np.log(np.where(low, x, 1)), shift)
        x = np.where(low, x + 1, x)
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


@lru_cache(8)
def stable_logs(discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of places and of the density there of the positive stable law whose Laplace transform is exp(-s^discount)."""
    d = discount
    angle = (np.arange(2000) + 0.5) * np.pi / 2000
    log_a = (d * np.log(np.sin(d * angle)) - np.log(np.sin(angle))) / (1 - d) + np.log(np.sin((1 - d) * angle))
    logs = np.linspace(-12.0, 40.0, 2601) / d * (1 - d)
    out = np.zeros(len(logs))
    for at in range(0, len(logs), 100):
        inside = log_a - np.exp(np.minimum(log_a - logs[at: at + 100, None] * d / (1 - d), 700))
        top = inside.max(1)
        out[at: at + 100] = top + np.log(np.exp(inside - top[:, None]).mean(1))
    return logs, np.log(d / (1 - d)) - logs / (1 - d) + out


def seat(customers: np.ndarray, new: np.ndarray, grow: np.ndarray, discount: float, stirling: np.ndarray, dish: np.ndarray, seed: int) -> np.ndarray:
    """Tables of each dish after its customers were seated again, drawn from their conditional distribution.

    The chance of t tables goes with the product of the generalised Stirling number of customers and tables and of
    ``new`` + i * ``grow`` for i below t: ``new`` is the weight of a first table, (strength + discount
    * other tables) * base probability, ``grow`` = discount * base probability. Beyond the ``stirling`` table
    the Stirling number is taken from its limit, the stable density of the customers scaled by tables. ``dish`` names
    the dishes for :func:`draws`.
    """
    tables = np.minimum(customers, 1).astype(np.int64)
    order = np.argsort(customers, kind="stable")
    counts = customers[order]
    exact = len(stirling) - 1
    for c in np.unique(counts[(counts > 1) & (counts <= exact)]).tolist():
        some = order[np.searchsorted(counts, c): np.searchsorted(counts, c, "right")]
        for at in range(0, len(some), 1 + 500_000 // c):
            rows = some[at: at + 1 + 500_000 // c]
            steps = np.log(np.maximum(new[rows, None] + grow[rows, None] * np.arange(c), 1e-300))
            weight = np.cumsum(steps, axis=1) + stirling[c, 1: c + 1]
            weight = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), axis=1)
            tables[rows] = 1 + (weight < draws(dish[rows], seed, 0)[:, None] * weight[:, -1:]).sum(1)
    some = order[np.searchsorted(counts, exact, "right"):]
    for at in range(0, len(some), 1000):
        rows = some[at: at + 1000]
        tables[rows] = many_tables(customers[rows], new[rows], grow[rows], discount, draws(dish[rows], seed, 0))
    return tables


def many_tables(customers: np.ndarray, new: np.ndarray, grow: np.ndarray, discount: float, u: np.ndarray) -> np.ndarray:
    """The number of tables at quantile ``u`` for dishes of many customers.

    A dish's tables have sizes of Sibuya's law, which adds up to the stable one. Chances are taken at every number
    of tables up to 64, beyond at steps of a thirtieth, between which they are even.
    """
    places = [*range(1, 65)]
    while places[-1] < customers.max():
        places.append(places[-1] + max(1, places[-1] // 30))
    t = np.array(places, float)
    width = np.diff(np.append(t, t[-1] + 1))
    grow = np.maximum(grow, 1e-300)
    a = np.maximum(new / grow, 1e-12)[:, None]
    logs, density = stable_logs(discount)
    x = np.log(customers)[:, None] - np.log(t) / discount
    weight = t * np.log(grow / discount)[:, None] + log_gamma(a + t) - log_gamma(t + 1) - np.log(t) / discount
    # Left of the places the density vanishes; right of them its tail is a power.
    tail = density[-1] - (1 + discount) * (x - logs[-1])
    weight += np.where(x < logs[0], -np.inf, np.where(x > logs[-1], tail, np.interp(x, logs, density)))
    weight = np.where(t <= customers[:, None], weight, -np.inf)
    weight = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)) * width, axis=1)
    goal = u * weight[:, -1]
    at = np.minimum((weight < goal[:, None]).sum(1), len(t) - 1)
    before = np.where(at > 0, weight[np.arange(len(at)), np.maximum(at - 1, 0)], 0.0)
    share = (goal - before) / np.maximum(weight[np.arange(len(at)), at] - before, 1e-300)
    return np.minimum(t[at] + np.floor(np.clip(share, 0, 1 - 1e-9) * width[at]), customers).astype(np.int64)


def discount_of(ones: float, twos: float) -> float:
    """The usual estimate from the numbers of dishes with one and two customers."""
    return float(min(0.95, max(0.05, ones / (ones + 2 * twos)))) if ones else 0.5


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (context of two, symbol) of all words' spellings in a row, and where each word begins."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    symbols = np.full(int(lengths.sum()) + len(words), END, np.int64)
    inside = np.ones(len(symbols), bool)
    inside[begin + lengths] = False
    symbols[inside] = np.frombuffer(b"".join(words), np.uint8)
    one = np.concatenate([[START], symbols[:-1]])
    one[begin] = START
    two = np.concatenate([[START], one[:-1]])
    two[begin] = START
    return (two * SYMBOLS + one) * SYMBOLS + symbols, begin


@dataclass
class Spelling:
    """Predictive probabilities of the spelling restaurants under one seating."""

    codes: np.ndarray  # of the cells of two preceding symbols, sorted
    own: np.ndarray  # (customers - discount * tables) / all, of each cell
    back: np.ndarray  # (SYMBOLS * SYMBOLS,) weight of the parent in each context of two
    parent: np.ndarray  # (SYMBOLS, SYMBOLS) probability after one preceding symbol

    def word_logs(self, words: list[bytes]) -> np.ndarray:
        """The natural logarithm of each word's probability of being spelled."""
        out = np.zeros(len(words))
        for at in range(0, len(words), 20_000):
            codes, begin = spelled(words[at: at + 20_000])
            p = self.back[codes // SYMBOLS] * self.parent[codes // SYMBOLS % SYMBOLS, codes % SYMBOLS]
            if len(self.codes):
                place = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
                p += np.where(self.codes[place] == codes, self.own[place], 0)
            out[at: at + 20_000] = np.add.reduceat(np.log(p), begin)
        return out


def resample_spelling(codes: np.ndarray, counts: np.ndarray, seed: int, sweeps: int = 4) -> Spelling:
    """A seating of the spelling restaurants, whose cells of two preceding symbols have ``counts`` customers.

    The cells number at most SYMBOLS ** 3, whatever the corpus.
    """
    context, symbol = codes // SYMBOLS, codes % SYMBOLS
    one = context % SYMBOLS
    uniform = np.full(SYMBOLS, 1.0 / (END + 1))
    uniform[START] = 0.0
    d = [discount_of((counts == 1).sum(), (counts == 2).sum()), 0.5, 0.5]
    logs = [stirling_logs(x) for x in d]
    t3 = np.minimum(counts, 1)
    t2 = np.zeros((SYMBOLS, SYMBOLS), np.int64)
    t1 = np.zeros(SYMBOLS, np.int64)
    p1, p2 = uniform, np.tile(uniform, (SYMBOLS, 1))
    for sweep in range(sweeps):
        if sweep:
            base = p2[one, symbol]
            total = np.bincount(context, t3, minlength=SYMBOLS * SYMBOLS)
            t3 = seat(counts, (STRENGTH + d[0] * (total[context] - t3)) * base, d[0] * base, d[0], logs[0], codes, seed + 3 * sweep)
        n2 = np.bincount(one * SYMBOLS + symbol, t3, minlength=SYMBOLS * SYMBOLS).astype(np.int64).reshape(SYMBOLS, SYMBOLS)
        t2 = np.where(t2 > 0, np.minimum(t2, n2), np.minimum(n2, 1))
        base = np.broadcast_to(p1, n2.shape)
        new = (STRENGTH + d[1] * (t2.sum(1, keepdims=True) - t2)) * base
        t2 = seat(n2.ravel(), new.ravel(), (d[1] * base).ravel(), d[1], logs[1], np.arange(n2.size), seed + 3 * sweep + 1).reshape(n2.shape)
        n1 = t2.sum(0)
        t1 = np.where(t1 > 0, np.minimum(t1, n1), np.minimum(n1, 1))
        t1 = seat(n1, (STRENGTH + d[2] * (t1.sum() - t1)) * uniform, d[2] * uniform, d[2], logs[2], np.arange(SYMBOLS), seed + 3 * sweep + 2)
        p1 = (n1 - d[2] * t1 + (STRENGTH + d[2] * t1.sum()) * uniform) / (STRENGTH + n1.sum())
        all2 = n2.sum(1, keepdims=True)
        p2 = (n2 - d[1] * t2 + (STRENGTH + d[1] * t2.sum(1, keepdims=True)) * p1) / (STRENGTH + all2)
    all3 = STRENGTH + np.bincount(context, counts, minlength=SYMBOLS * SYMBOLS)
    back = (STRENGTH + d[0] * np.bincount(context, t3, minlength=SYMBOLS * SYMBOLS)) / all3
    return Spelling(codes, (counts - d[0] * t3) / all3[context], back, p2)


def packed(values: np.ndarray, kind: str | np.dtype = "<u4") -> bytes:
    """Numbers, or records of them, as compressed bytes, first all lowest bytes, then the next ones; small numbers take little room."""
    kind = np.dtype(kind)
    raw = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(-1, kind.itemsize).T.tobytes()
    return len(values).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(data: bytes, kind: str | np.dtype = "<u4") -> np.ndarray:
    kind, n = np.dtype(kind), int.from_bytes(data[:4], "little")
    if not n:
        return np.zeros(0, kind)
    raw = pa.decompress(data[4:], decompressed_size=n * kind.itemsize, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T).view(kind)[:, 0]


def tokenised(docs: DataFrame) -> DataFrame:
    """Blocks of documents, and their words, in one table.

    A block is a run of a partition's documents of about BLOCK_BYTES. A document's row has its tokens as places in
    the block's dictionary (seq) and their number n. A word's row has its place and its training tokens n.
    The empty word, at place 0, is the end of a text and, as a preceding word, its start.
    """
    kinds = {"block": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "seq": pa.binary(), "word": pa.binary(), "place": pa.int32(), "n": pa.int64()}

    def batch_of(block: int, size: int, **columns) -> pa.RecordBatch:
        filled = columns | {"block": np.full(size, block)}
        return pa.RecordBatch.from_arrays([pa.array(filled[k], kind) if k in filled else pa.nulls(size, kind) for k, kind in kinds.items()], names=list(kinds))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def places() -> defaultdict[bytes, int]:
            """The place of each word; a new one gets the next."""
            index: defaultdict[bytes, int] = defaultdict()
            index.default_factory = index.__len__
            index[b""]
            return index

        block, size, index, learnt = TaskContext.get().partitionId() << 24, 0, places(), []

        def dictionary() -> Iterator[pa.RecordBatch]:
            n = np.bincount(np.concatenate([np.zeros(0, np.int32), *learnt]), minlength=len(index))
            words = list(index)
            for at in range(0, len(words), 50_000):
                part = words[at: at + 50_000]
                yield batch_of(block, len(part), word=part, place=np.arange(at, at + len(part)), n=n[at: at + 50_000])

        for batch in sliced(batches):
            out: dict[str, list] = {"doc_id": [], "held_out": [], "seq": [], "n": []}
            for doc, held, text in zip(*(x.to_pylist() for x in batch.columns)):
                words = text.lower().split()
                words.append(b"")
                seq = np.fromiter(map(index.__getitem__, words), np.int32, len(words))
                if not held:
                    learnt.append(seq)
                for k, v in zip(out, (doc, held, packed(seq), len(seq))):
                    out[k].append(v)
                size += len(text)
            yield batch_of(block, batch.num_rows, **out)
            if size > BLOCK_BYTES:
                yield from dictionary()
                block, size, index, learnt = block + 1, 0, places(), []
        yield from dictionary()

    bounded_batches(docs.sparkSession)
    held_out = F.coalesce(crc_of_id() % 10 == 0, F.lit(True))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), byte_text().alias("data")).mapInArrow(
        of, "block long, doc_id long, held_out boolean, seq binary, word binary, place int, n long"
    )


def merged_words(table: DataFrame) -> DataFrame:
    """(part, number, word, n, at): each word of the blocks' rows (word, block, place, n) once, with the sum of its n and its places.

    Words are numbered within partitions, in their order.
    """

    def merged(rows: pa.RecordBatch, first: np.ndarray, part: int, number: int) -> pa.RecordBatch:
        at = pa.StructArray.from_arrays([rows.column(1), rows.column(2)], names=["block", "place"])
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(len(first), part)), pa.array(np.arange(number, number + len(first))), rows.column(0).take(pa.array(first)),
            pa.array(np.add.reduceat(rows.column(3).to_numpy(), first)),
            pa.ListArray.from_arrays(pa.array(np.append(first, rows.num_rows), pa.int32()), at),
        ], names=["part", "number", "word", "n", "at"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        last: list[pa.RecordBatch] = []  # the rows so far of the last word, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            if last and batch.column(0)[batch.num_rows - 1] == last[0].column(0)[0]:
                last.append(batch)
                continue
            rows = pa.concat_batches([*last, batch])
            words = rows.column(0)
            first = np.flatnonzero(np.concatenate([[True], pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)]))
            if len(first) > 1:
                yield merged(rows.slice(0, first[-1]), first[:-1], part, number)
                number += len(first) - 1
            last = [rows.slice(first[-1])]
        if last:
            yield merged(pa.concat_batches(last), np.zeros(1, np.int64), part, number)

    rows = table.select("word", "block", "place", "n").repartition("word").sortWithinPartitions("word")
    return rows.mapInArrow(of, "part long, number long, word binary, n long, at array<struct<block:long,place:int>>")


def numbered(words: DataFrame) -> DataFrame:
    """(id, h, word, n, at) of the stored :func:`merged_words`: ids count from 0 without gaps, h is a hash of the word.

    The driver fetches one number a partition. A pair of ids has to fit 64 bits, so 2^32 words are an error.
    """
    first, total = [], 0
    for row in words.groupBy("part").agg(F.count("*").alias("rows")).orderBy("part").collect():
        first.append((row["part"], total))
        total += row["rows"]
    if total >= MASK:
        raise OverflowError(f"{total} distinct words; pairs of their numbers don't fit 64 bits")
    part, begin = (pa.array([x[i] for x in first], pa.int64()) for i in (0, 1))
    offsets = words.sparkSession.createDataFrame(pa.table({"part": part, "begin": begin}))
    id_of = (F.col("begin") + F.col("number")).alias("id")
    return words.join(F.broadcast(offsets), "part").select(id_of, F.xxhash64("word").alias("h"), "word", "n", "at")


#: What a block needs to know of a word to find its pairs.
NAMED = np.dtype([("place", "<u4"), ("id", "<u4")])


def addressed(rows: DataFrame, kind: np.dtype, of: Callable[[pa.RecordBatch], dict[str, np.ndarray]]) -> DataFrame:
    """(block, data): words' records of ``kind``, each sent to the blocks and places of the rows' column at.

    ``of`` gives the fields of a batch's words but for place; id, which is sent as steps, is one of them. A task
    packs the records of one block together, PACKED_ROWS of all blocks at a time.
    """

    def packs(blocks: list[np.ndarray], records: list[np.ndarray]) -> pa.RecordBatch:
        block, record = np.concatenate([np.zeros(0, np.int64), *blocks]), np.concatenate([np.zeros(0, kind), *records])
        blocks.clear()
        records.clear()
        order = np.argsort(block, kind="stable")
        found, first = np.unique(block[order], return_index=True)
        data = []
        for at in np.split(order, first[1:]) if len(found) else []:
            part = record[at]
            part["id"] = np.diff(part["id"], prepend=np.uint32(0))
            data.append(packed(part, kind))
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(data, pa.binary())], names=["block", "data"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, records, waiting = [], [], 0
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("at"))
            each = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy())
            block, place = lists.flatten().flatten()
            record = np.zeros(len(each), kind)
            record["place"] = place.to_numpy()
            for field, values in of(batch).items():
                record[field] = values[each]
            blocks.append(block.to_numpy())
            records.append(record)
            waiting += len(each)
            if waiting > PACKED_ROWS:
                yield packs(blocks, records)
                waiting = 0
        yield packs(blocks, records)

    return rows.mapInArrow(send, "block long, data binary")


def by_place(data: Iterable[bytes], kind: np.dtype) -> np.ndarray:
    """The records of one block's words, each at its place."""
    parts = []
    for each in data:
        part = unpacked(each, kind).copy()
        part["id"] = np.cumsum(part["id"], dtype=np.uint32)
        parts.append(part)
    every = np.concatenate([np.zeros(0, kind), *parts])
    out = np.zeros(len(every), kind)
    out[every["place"]] = every
    return out


def letter_counts(state: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Customers of each spelling cell: the tables ``t`` of all words, summed on the executors."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, sums = np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            tables = batch["t"].to_numpy()
            for at in range(0, len(batch), 20_000):
                words = batch["word"].iloc[at: at + 20_000].tolist()
                codes, begin = spelled(words)
                each = np.repeat(tables[at: at + 20_000], np.diff(np.append(begin, len(codes))))
                found, place = np.unique(np.concatenate([found, codes]), return_inverse=True)
                sums = np.bincount(place, np.concatenate([sums, each]))
        yield pd.DataFrame({"code": found, "n": sums.astype(np.int64)})

    cells = state.where("t > 0").select("word", "t").mapInPandas(of, "code long, n long")
    rows = cells.groupBy("code").agg(F.sum("n").alias("n")).toPandas().sort_values("code")
    return rows["code"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


def by_block(blocks: DataFrame, values: DataFrame, of: Callable, schema: str) -> DataFrame:
    """``of(documents, words)`` for each block: its documents' rows and what its words' tasks packed for it."""
    return blocks.groupBy("block").cogroup(values.groupBy("block")).applyInPandas(of, schema)


def token_runs(docs: pd.DataFrame, tokens: int = 400_000) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of documents of about ``tokens``: their rows, where each begins, the places of their tokens, and of the words before."""
    ends = np.cumsum(docs["n"].to_numpy())
    at = 0
    while at < len(docs):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + tokens)))
        rows = docs.iloc[at:to]
        seqs = [unpacked(x) for x in rows["seq"]]
        begin = np.concatenate([[0], np.cumsum([len(x) for x in seqs])[:-1]])
        seq = np.concatenate(seqs).astype(np.int64)
        # A text ends with the word of place 0, which is also the one before the next text.
        yield rows, begin, seq, np.concatenate([[0], seq[:-1]])
        at = to


def known_codes(seq: np.ndarray, before: np.ndarray, id_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens and words before them are both known, and those pairs' codes."""
    a, b = id_of[before], id_of[seq]
    both = (a >= 0) & (b >= 0)
    return both, a[both] << 32 | b[both]


def counted(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes and their numbers; sorted in place, as there may be millions."""
    every = np.concatenate([np.zeros(0, np.int64), *codes])
    codes.clear()
    every.sort()
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
    return every[first], np.diff(np.append(first, len(every)))


def places_in(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key in a sorted table; keys are looked up in ascending order, so that memory is read in order, too."""
    order = np.argsort(keys)
    out = np.empty(len(keys), np.int64)
    out[order] = np.searchsorted(table, keys[order])
    return out


def shard_of(codes: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(codes) % np.uint64(shards)).astype(np.int64)


def pair_shards(blocks: DataFrame, ids: DataFrame, shards: int) -> DataFrame:
    """(block, shard, codes, n): the block's distinct pairs (id of the word before << 32 | id), sorted, and their training tokens.

    ``ids`` (block, data) has the words as :data:`NAMED` records, whose id is one more, and 0 if training never had the word;
    pairs with such a word are left out.
    """

    def of(docs: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        columns = ["block", "shard", "codes", "n"]
        id_of = by_place(words["data"], NAMED)["id"].astype(np.int64) - 1
        learnt, others = [], []
        for rows, begin, seq, before in token_runs(docs):
            both, codes = known_codes(seq, before, id_of)
            held = np.repeat(rows["held_out"].to_numpy(bool), np.diff(np.append(begin, len(seq))))[both]
            learnt.append(codes[~held])
            others.append(codes[held])
        found, n = counted(learnt)
        more = counted(others)[0]
        more = np.setdiff1d(more, found, assume_unique=True)
        place = np.searchsorted(found, more)
        found, n = np.insert(found, place, more), np.insert(n, place, 0)
        if docs.empty or not len(found):
            return pd.DataFrame(columns=columns)
        own = shard_of(found, shards)
        order = np.argsort(own, kind="stable")
        bounds = np.searchsorted(own[order], np.arange(shards + 1))
        rows = []
        for shard in range(shards):
            at = order[bounds[shard]: bounds[shard + 1]]
            if len(at):
                rows.append((docs["block"].iloc[0], shard, packed(np.diff(found[at], prepend=0), "<u8"), packed(n[at])))
        return pd.DataFrame(rows, columns=columns)

    return by_block(blocks, ids, of, "block long, shard long, codes binary, n binary")


SHARD = "shard long, block long, before binary, word binary, c binary, t binary, own binary, place binary, singles binary, single_words binary"


def counted_shards(messages: DataFrame) -> DataFrame:
    """Of each shard, one row with the repeated pairs, and one row for each block that says where its pairs are among them.

    A pair of one training token has one table in any seating, so it is only counted: by the word before it and by
    its word, as (id, number) in ``singles`` and ``single_words``. ``place`` has for each of the block's pairs,
    in their order, 0 for none learnt, 1 for a single one, else 2 more than its place.
    """

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        codes = [np.cumsum(unpacked(x, "<u8").astype(np.int64)) for x in rows["codes"]]
        n = [unpacked(x).astype(np.int64) for x in rows["n"]]
        every, place = np.unique(np.concatenate(codes), return_inverse=True)
        c = np.bincount(place, np.concatenate(n), minlength=len(every)).astype(np.int64)
        single, repeated = every[c == 1], every[c > 1]
        mark = np.where(c > 1, np.cumsum(c > 1) + 1, np.minimum(c, 1))
        shard, ends = rows["shard"].iloc[0], np.cumsum([len(x) for x in codes])
        counted = [np.unique(x, return_counts=True) for x in (single >> 32, single & MASK)]
        first = (
            shard, None, packed(repeated >> 32), packed(repeated & MASK), packed(c[c > 1]), packed(np.ones(len(repeated))), packed(np.zeros(len(repeated)), "<f4"), None,
            *[packed(np.concatenate(x)) for x in counted],
        )
        others = [(shard, block, *[None] * 5, packed(mark[p]), None, None) for block, p in zip(rows["block"], np.split(place, ends[:-1]))]
        return pd.DataFrame([first, *others], columns=[x.split()[0] for x in SHARD.split(", ")])

    return messages.groupBy("shard").applyInPandas(of, SHARD)


def sums_by_word(shards: DataFrame, single: bool) -> DataFrame:
    """(id, c, tu): the tables of each word in all restaurants, and those of all words after it; of single or of repeated pairs."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                if single:
                    (w, c), (u, tu) = (unpacked(x).astype(np.int64).reshape(2, -1) for x in (row.single_words, row.singles))
                else:
                    t = unpacked(row.t).astype(np.int64)
                    (w, c), (u, tu) = (summed(unpacked(x).astype(np.int64), t) for x in (row.word, row.before))
                yield pd.DataFrame({"id": np.concatenate([w, u]), "c": np.concatenate([c, 0 * tu]), "tu": np.concatenate([0 * c, tu])})

    own = shards.select(*(("singles", "single_words") if single else ("before", "word", "t")))
    return own.mapInPandas(of, "id long, c long, tu long").groupBy("id").agg(F.sum("c").alias("c"), F.sum("tu").alias("tu"))


def summed(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, and the sum of each one's values."""
    every, place = np.unique(ids, return_inverse=True)
    return every, np.bincount(place, values, minlength=len(every)).astype(np.int64)


def shard_words(shards: DataFrame) -> DataFrame:
    """(shard, id) of the words in each shard's repeated pairs."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids = np.unique(np.concatenate([unpacked(row.before), unpacked(row.word)])).astype(np.int64)
                yield pd.DataFrame({"shard": row.shard, "id": ids})

    return shards.select("shard", "before", "word").mapInPandas(of, "shard long, id long")


@dataclass
class Model:
    """Seatings of a corpus: of each sample, what the words and the repeated pairs have, and what holds for all."""

    words: DataFrame  # q_i, a logarithm, and tu_i of the words of over one token
    shards: DataFrame
    spellings: list[Spelling]
    unseen: list[float]  # of each sample, the weight of the spelling
    alone: list[float]  # and what a word of one token has beside it
    discount: float
    tokens: int
    distinct: int


def pair_seater(discount: float, parents: int, samples: int, taken: bool, seed: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Seats the repeated pairs of one shard given its words' rows (id, h, n, tu, q); ``parents`` counts the parent's customers."""

    def seat_pairs(shard: pd.DataFrame, named: pd.DataFrame) -> pd.DataFrame:
        if shard.empty:
            return shard
        row, ids = shard.iloc[0], named["id"].to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        before, word, c, t = (unpacked(row[x]).astype(np.int64) for x in ("before", "word", "c", "t"))
        u, w = order[np.searchsorted(ids, before)], order[places_in(ids, word)]
        h = mixed(named["h"].to_numpy().view(np.uint64))
        n, tu, q = named["n"].to_numpy()[u], named["tu"].to_numpy()[u], named["q"].to_numpy()[w]
        # The parent's probability without this dish's own customers there, one for each table.
        alone = np.maximum(q - t / (STRENGTH + parents), q * 1e-3)
        new = seat(c, (STRENGTH + discount * (tu - t)) * alone, discount * alone, discount, stirling_logs(discount), h[u] * np.uint64(3) ^ h[w], seed)
        own = unpacked(row["own"], "<f4")
        if taken:
            own = own + (c - discount * t) / (STRENGTH + n) / samples
        return shard.assign(t=[packed(new)], own=[packed(own, "<f4")])

    return seat_pairs


def seatings(words: DataFrame, shards: DataFrame, burn_in: int, samples: int, seed: int = 17) -> Model:
    """The model of the stored ``words`` (id, h, word, n) and ``shards`` (as of :func:`counted_shards`).

    A sweep seats the words' restaurant, then all restaurants of preceding words given its probabilities, each
    dish's own tables taken out first. A word of one token has one customer, one table and one table after it in any
    seating, so such words take no part in the sweeps.
    """
    names = stored(shard_words(shards), "shard-words")
    kept = [f"{x}_{i}" for i in range(samples) for x in ("q", "tu")]
    columns = ["id", "h", "word", "n", "fc", "fu", "c", "tu", "t", "q", *kept]
    zero, none = F.lit(0).cast("long"), F.lit(0.0).cast("float")

    def with_sums(state: DataFrame, old: DataFrame | None) -> DataFrame:
        out = state.drop("c", "tu").join(sums_by_word(shards, False), "id", "left").fillna(0, ["c", "tu"])
        out = out.withColumns({"c": F.col("c") + F.col("fc"), "tu": F.col("tu") + F.col("fu")})
        t = F.least("c", F.greatest("t", F.least("c", F.lit(1).cast("long"))))
        return stored(out.withColumn("t", t).select(*columns), "seating", old)

    single = sums_by_word(shards, True).select("id", F.col("c").alias("fc"), F.col("tu").alias("fu"))
    once = words.where("n = 1").select("word", F.lit(1).cast("long").alias("t"))
    once_letters = letter_counts(once)
    facts = words.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("once")).first()
    fixed = facts["once"] or 0
    state = words.where("n > 1").select("id", "h", "word", "n").join(single, "id", "left").fillna(0, ["fc", "fu"])
    state = with_sums(state.select("*", zero.alias("t"), none.alias("q"), *[(none if x[0] == "q" else zero).alias(x) for x in kept]), None)
    few = state.agg(F.count_if(F.col("c") == 1).alias("ones"), F.count_if(F.col("c") == 2).alias("twos")).first()
    discount = discount_of(few["ones"] + fixed, few["twos"])
    few = shards.mapInPandas(once_and_twice, "ones long, twos long").agg(F.sum("ones").alias("ones"), F.sum("twos").alias("twos")).first()
    pair_discount = discount_of(few["ones"] or 0, few["twos"] or 0)
    spellings, unseen, alone = [], [], []
    for sweep in range(burn_in + samples if facts["v"] else 0):
        sample = sweep - burn_in
        letters = [np.concatenate(x) for x in zip(letter_counts(state), once_letters)]
        spelling = resample_spelling(*summed(*letters), seed=seed + 1000 * sweep)
        row = state.agg(F.sum("c").alias("c"), F.sum("t").alias("t")).first()
        parents, tables = (row["c"] or 0) + fixed, (row["t"] or 0) + fixed
        weight = (STRENGTH + discount * tables) / (STRENGTH + parents)

        def seat_words(batches, sweep=sweep, sample=sample, spelling=spelling, parents=parents, tables=tables) -> Iterator[pd.DataFrame]:
            logs = stirling_logs(discount)
            for batch in batches:
                if batch.empty:
                    continue
                base = np.exp(spelling.word_logs(batch["word"].tolist()))
                t, c, dish = batch["t"].to_numpy(), batch["c"].to_numpy(), batch["h"].to_numpy()
                new = seat(c, (STRENGTH + discount * (tables - t)) * base, discount * base, discount, logs, dish, seed + 1000 * sweep + 500)
                q = (c - discount * t + (STRENGTH + discount * tables) * base) / (STRENGTH + parents)
                taken = {f"q_{sample}": np.log(q), f"tu_{sample}": batch["tu"].to_numpy()} if sample >= 0 else {}
                yield batch.assign(t=new, q=q, **taken)

        state = stored(state.mapInPandas(seat_words, state.schema), "seating", state)
        if sample >= 0:
            spellings.append(spelling)
            unseen.append(weight)
            alone.append((1 - discount) / (STRENGTH + parents))
        beside = names.join(state.select("id", "h", "n", "tu", "q"), "id")
        seater = pair_seater(pair_discount, parents, samples, sample >= 0, seed + 1000 * sweep + 700)
        old = shards if sweep else None
        shards = stored(shards.groupBy("shard").cogroup(beside.groupBy("shard")).applyInPandas(seater, SHARD), "shards", old)
        if sweep + 1 < burn_in + samples:
            state = with_sums(state, state)
    discard(names)
    return Model(state, shards, spellings, unseen, alone, pair_discount, facts["n"] or 0, facts["v"])


def once_and_twice(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many pairs have one token, and how many two."""
    for batch in batches:
        for row in batch.itertuples():
            ones = int(unpacked(row.singles).astype(np.int64).reshape(2, -1)[1].sum())
            yield pd.DataFrame({"ones": [ones], "twos": [int((unpacked(row.c) == 2).sum())]})


def shard_values(places: DataFrame, model: Model) -> DataFrame:
    """(block, shard, values): of each of the block's pairs, in their order, the share of its own tokens; -1 for a single one."""

    def of(rows: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        columns = ["block", "shard", "values"]
        if rows.empty or shard.empty:
            return pd.DataFrame(columns=columns)
        table = np.concatenate([[0.0, -1.0], unpacked(shard.iloc[0]["own"], "<f4")])
        out = [(r.block, r.shard, packed(table[unpacked(r.place).astype(np.int64)], "<f4")) for r in rows.itertuples()]
        return pd.DataFrame(out, columns=columns)

    return places.groupBy("shard").cogroup(model.shards.select("shard", "own").groupBy("shard")).applyInPandas(of, "block long, shard long, values binary")


def language_model_scores(docs: DataFrame, burn_in: int = 2, samples: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row.

    Tokens are words between ASCII white space, A-Z lower-cased, then an end. Learnt are the
    rows whose crc32(doc_id as text) mod 10 isn't 0; a null doc_id is held out. base_score is the
    add-0.1 unigram's log10 probability of the text, score the model's, in which a word that the training
    never had is spelled. A null text is empty and has its end only. Where there is nothing to
    learn from, both scores are 0. Repeated rows stay; other columns are ignored; an empty table
    gives no rows. Scores don't depend on how rows are dealt.
    """
    table = stored(tokenised(docs), "tokens")
    blocks = table.where("word is null").select("block", "doc_id", "held_out", "seq", "n")
    words = numbered(stored(merged_words(table.where("word is not null")), "words"))
    learnt = words.where("n > 0")
    tokens = learnt.agg(F.sum("n").alias("n")).first()["n"] or 0
    shards = max(1, math.ceil(tokens / SHARD_TOKENS))

    def known_ids(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        return {"id": batch.column(1).to_numpy()}

    ids = addressed(words.select("at", F.when(F.col("n") > 0, F.col("id") + 1).otherwise(0).alias("id")), NAMED, known_ids)
    made = stored(counted_shards(pair_shards(blocks, ids, shards)), "shards")
    model = seatings(learnt.select("id", "h", "word", "n"), made.where("block is null"), burn_in, samples)
    values = shard_values(made.where("block is not null").select("block", "shard", "place"), model)
    kept = [f"{x}_{i}" for i in range(samples) for x in ("q", "tu")]
    spellings, unseen, alone = model.spellings, model.unseen, model.alone

    record = np.dtype([("place", "<u4"), ("id", "<u4"), ("n", "<u8"), *[(x, "<f4" if x[0] == "q" else "<u8") for x in kept]])

    def spell(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        """Words of several tokens have their values; the others, whose ``word`` is there, are spelled."""
        rare = batch.column(batch.num_columns - 1).is_valid()
        words = batch.column(batch.num_columns - 1).drop_null().to_pylist()
        rare, n = rare.to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
        out = {"id": batch.column(1).to_numpy(), "n": n}
        for i in range(samples):
            q, tu = (batch.column(3 + 2 * i + x).fill_null(0).to_numpy().copy() for x in (0, 1))
            tu[rare] = n[rare]
            if i < len(spellings):
                with np.errstate(divide="ignore"):
                    q[rare] = np.logaddexp(math.log(unseen[i]) + spellings[i].word_logs(words), np.log(alone[i] * n[rare]))
            out |= {f"q_{i}": q, f"tu_{i}": tu}
        return out

    values_of = [F.lit(None).cast("float" if x[0] == "q" else "long").alias(x) for x in kept]
    rare = words.where("n <= 1").select("at", "id", "n", *values_of, "word")
    known = words.where("n > 1").select("at", "id").join(model.words.select("id", "n", *kept), "id").select("at", "id", "n", *kept, F.lit(None).cast("binary").alias("word"))
    sent = addressed(known.union(rare), record, spell)
    # What was packed of the words and the shards' values of a block come together.
    beside = sent.select("*", F.lit(None).cast("long").alias("shard"), F.lit(None).cast("binary").alias("values")).union(
        values.select("block", F.lit(None).cast("binary").alias("data"), "shard", "values")
    )
    total, discount = model.tokens, model.discount
    bottom = total + 0.1 * (model.distinct + 1)
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def of(texts: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if texts.empty:
            return pd.DataFrame(columns=columns)
        words = by_place(rows["data"].dropna(), record)
        n = words["n"].astype(float)
        id_of = np.where(n > 0, words["id"].astype(np.int64), -1)
        q = [words[f"q_{i}"].astype(float) for i in range(samples)]
        back = [np.log((STRENGTH + discount * words[f"tu_{i}"]) / (STRENGTH + n) / samples) for i in range(samples)]
        base, single = np.log10((n + 0.1) / bottom), (1 - discount) / (STRENGTH + n)
        own = {int(r.shard): unpacked(r.values, "<f4") for r in rows[rows["shard"].notna()].itertuples(index=False)}
        found = counted([known_codes(seq, before, id_of)[1] for _, _, seq, before in token_runs(texts)])[0]
        value = np.zeros(len(found), np.float32)
        if len(found):
            owner = shard_of(found, shards)
            order = np.argsort(owner, kind="stable")
            bounds = np.searchsorted(owner[order], np.arange(shards + 1))
            for shard, part in own.items():
                value[order[bounds[shard]: bounds[shard + 1]]] = part
        out = []
        for some, begin, seq, before in token_runs(texts):
            both, codes = known_codes(seq, before, id_of)
            p = np.zeros(len(seq))
            v = value[places_in(found, codes)]
            p[both] = np.where(v < 0, single[before[both]], v)
            # A long word's spelling is less likely than a float can say, so logarithms are added.
            with np.errstate(divide="ignore"):
                p = np.log(p)
            for i in range(samples if total else 0):
                p = np.logaddexp(p, back[i][before] + q[i][seq])
            sums = [np.add.reduceat(x, begin) for x in ((n[seq] > 0).astype(np.int64), base[seq], p / math.log(10))]
            if not total:
                sums = [0 * sums[0], 0 * sums[1], 0 * sums[1]]
            out.append(pd.DataFrame({
                "doc_id": some["doc_id"], "held_out": some["held_out"], "n_tokens": some["n"], "n_known": sums[0], "train_tokens": total,
                "base_score": sums[1], "score": sums[2],
            }))
        return pd.concat(out)[columns].astype({"doc_id": "Int64"})

    return by_block(blocks, beside, of, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def perplexity(scores: DataFrame) -> DataFrame:
    """(held_out, n_tokens, base_perplexity, perplexity) of scored rows: 10 to the mean negative score of a token.

    A fold without rows has no row.
    """

    def of(column: str) -> Column:
        return F.pow(F.lit(10.0), -F.sum(column) / F.sum("n_tokens"))

    return scores.groupBy("held_out").agg(
        F.sum("n_tokens").alias("n_tokens"), of("base_score").alias("base_perplexity"), of("score").alias("perplexity")
    )
