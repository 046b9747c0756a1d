"""Packing documents into sequences by a grouping genetic algorithm on islands.

An individual is a whole packing, and its genes are bins. Crossover injects well-filled
bins of one parent into the other, removes the bins that hold any of the same documents,
and puts the displaced documents back by best fit. The documents are dealt into shards by
hash; several islands evolve a population for each shard, and after each epoch an island
sends its elite to the next one. The shards' badly filled bins are then dissolved and
their documents dealt into fewer shards for one more evolution, so what sharding costs
doesn't grow with the number of shards.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairloom.llm.common import BYTE_PATTERN, bounded_batches, byte_characters, has_long_blanks, sliced, stored

#: Below this character all versions of Unicode agree on letters, numbers and white space.
UNUSUAL = re.compile("[^\x00-\u024f]")


class TextEncoder:
    """Token ids of texts under a byte-level vocabulary file of the ``tokenizers`` library.

    Its ids rise with the ranks of its merges, so ``tiktoken`` gives the same ids several times
    faster; texts with characters whose class depends on a library's version of Unicode, or with
    long runs of white space, go to ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        self.path, self.library = path, None
        library = Tokenizer.from_file(path)
        added = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
        byte = byte_characters()
        vocabulary = library.get_vocab(with_added_tokens=False)
        ranks = {bytes(map(byte.__getitem__, token)): i for token, i in vocabulary.items() if token not in added}
        self.quick = tiktoken.Encoding("vocabulary", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self.added = set(added)

    def ids(self, text: str) -> bytes:
        """The ids of a text, little-endian and of 32 bits, without special tokens at its ends."""
        if UNUSUAL.search(text) or has_long_blanks(text):
            self.library = self.library or Tokenizer.from_file(self.path)
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.quick.encode_to_numpy(text, allowed_special=self.added).astype("<u4").tobytes()


@lru_cache(1)
def loaded(path: str) -> TextEncoder:
    """One per worker process."""
    return TextEncoder(path)


def document_pieces(docs: DataFrame, vocabulary: str, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the pieces of each document, its end id 0 included.

    A document of over ``capacity`` ids is cut so that all its pieces but the first are full.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(vocabulary)
        for batch in sliced(batches):
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc, text in zip(batch.column(0), batch.column(1)):
                doc, ids = doc.as_py(), encoder.ids(text.as_py() or "") + b"\0\0\0\0"
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                starts = [0, *range(first, n, capacity)]
                for piece, (i, j) in enumerate(zip(starts, [*starts[1:], n])):
                    for name, value in zip(out, (doc, piece, i, j - i, zlib.crc32(ids[4 * i: 4 * j]))):
                        out[name].append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        of, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(items: list[int], sizes: list[int], bins: list[list[int]], capacity: int) -> None:
    """Puts ``items``, in their order, into the fullest of ``bins`` that has room, or into a new one.

    Bins of each free space are stacked, and one integer has a bit for each space that occurs,
    so the tightest fit is found without a search through the bins.
    """
    stacks: dict[int, list[list[int]]] = {}
    spaces = 0
    for own in bins:
        space = capacity - sum(map(sizes.__getitem__, own))
        stacks.setdefault(space, []).append(own)
        spaces |= 1 << space
    for item in items:
        size = sizes[item]
        room = spaces >> size
        if room:
            space = size + (room & -room).bit_length() - 1
            stack = stacks[space]
            own = stack.pop()
            if not stack:
                spaces ^= 1 << space
        else:
            own, space = [], capacity
            bins.append(own)
        own.append(item)
        space -= size
        stacks.setdefault(space, []).append(own)
        spaces |= 1 << space


def fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins are better, and of as many bins those with their fill least even."""
    return -len(bins), sum((sum(map(sizes.__getitem__, own)) / capacity) ** 2 for own in bins)


def packed(order: list[int], sizes: list[int], capacity: int) -> list[list[int]]:
    bins: list[list[int]] = []
    best_fit(order, sizes, bins, capacity)
    return bins


def crossed(mother: list[list[int]], father: list[list[int]], sizes: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """The mother's packing with a share of the father's best-filled bins injected."""
    fill = np.array([sum(map(sizes.__getitem__, own)) for own in father])
    best = np.argsort(-fill, kind="stable")[: max(1, len(father) // 2)]
    chosen = rng.choice(best, max(1, len(best) // 2), replace=False)
    injected = [father[i][:] for i in chosen]
    there = {item for own in injected for item in own}
    kept, displaced = injected, []
    for own in mother:
        if there.isdisjoint(own):
            kept.append(own[:])
        else:
            displaced += [item for item in own if item not in there]
    displaced.sort(key=sizes.__getitem__, reverse=True)
    best_fit(displaced, sizes, kept, capacity)
    return kept


def mutated(bins: list[list[int]], sizes: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """The packing after its emptiest bin and a few at random were dissolved and best-fitted again."""
    fill = [sum(map(sizes.__getitem__, own)) for own in bins]
    gone = {int(np.argmin(fill)), *rng.integers(0, len(bins), min(3, len(bins))).tolist()}
    kept = [own[:] for n, own in enumerate(bins) if n not in gone]
    displaced = [item for n in gone for item in bins[n]]
    displaced.sort(key=sizes.__getitem__, reverse=True)
    best_fit(displaced, sizes, kept, capacity)
    return kept


def evolve(sizes: list[int], population: list[list[list[int]]], capacity: int, generations: int, rng: np.random.Generator) -> list[list[list[int]]]:
    """The population after ``generations``, best first. It stops when the sum of sizes allows no fewer bins."""
    least = -(-sum(sizes) // capacity)
    ranked = sorted(population, key=lambda b: fitness(b, sizes, capacity), reverse=True)
    for _ in range(generations):
        if len(ranked[0]) <= least:
            break
        i, j = rng.choice(len(ranked), 2, replace=False) if len(ranked) > 1 else (0, 0)
        child = crossed(ranked[i], ranked[j], sizes, capacity, rng)
        child = mutated(child, sizes, capacity, rng)
        ranked = sorted([*ranked, child], key=lambda b: fitness(b, sizes, capacity), reverse=True)[: len(population)]
    return ranked


def first_population(sizes: list[int], capacity: int, rng: np.random.Generator, size: int) -> list[list[list[int]]]:
    """Best fit of the sizes in falling order, and of orders that noise has shaken."""
    array = np.array(sizes, float)
    orders = [np.argsort(-array * (1 + k * 0.08 * rng.random(len(array))), kind="stable").tolist() for k in range(size)]
    return [packed(order, sizes, capacity) for order in orders]


def bin_numbers(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.zeros(n, np.int32)
    for number, own in enumerate(bins):
        out[own] = number
    return out


def bins_of(numbers: np.ndarray) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(int(numbers.max(initial=-1)) + 1)]
    for item, number in enumerate(numbers.tolist()):
        out[number].append(item)
    return out


ISLANDS_PER_TASK, MOST_TASKS = 16, 20_000
STATE = "shard long, island int, sizes array<int>, elite array<int>, guest array<int>"


def on_islands(items: DataFrame, shards: int, capacity: int, islands: int, epochs: int, generations: int, population: int) -> DataFrame:
    """(shard, bins array<int>): for each shard's items, in order of ``item``, the number of their bin.

    ``items`` has shard (about ``shards`` of them), item (any order key) and size. A shard's sizes
    are gathered into one row: shards are dealt by hash to hold a bounded number of items. The
    rows are few bytes and much work, so tasks are counted by islands.
    """
    tasks = max(1, min(shards * islands // ISLANDS_PER_TASK, MOST_TASKS))
    rows = items.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("item", "size"))).alias("all"))
    state = rows.select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
        F.col("all.size").cast("array<int>").alias("sizes"),
        F.array().cast("array<int>").alias("elite"), F.array().cast("array<int>").alias("guest"),
    )
    for epoch in range(epochs):

        def live(batches: Iterator[pd.DataFrame], epoch: int = epoch) -> Iterator[pd.DataFrame]:
            for batch in batches:
                elites = []
                for row in batch.itertuples():
                    sizes = row.sizes.tolist()
                    rng = np.random.default_rng([row.shard & 0xFFFFFFFF, row.island, epoch])
                    people = first_population(sizes, capacity, rng, population)
                    people += [bins_of(x) for x in (row.elite, row.guest) if len(x)]
                    elites.append(bin_numbers(evolve(sizes, people, capacity, generations, rng)[0], len(sizes)))
                yield batch.assign(elite=elites)

        state = stored(state.repartition(tasks, "shard", "island").mapInPandas(live, STATE), "islands")
        if epoch + 1 < epochs:
            sent = state.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.col("elite").alias("guest"))
            state = state.drop("guest").join(sent, ["shard", "island"]).select("shard", "island", "sizes", "elite", "guest")
    best = F.min(F.struct(F.array_max("elite").alias("bins"), F.col("island"), F.col("elite")))
    return state.groupBy("shard").agg(best.alias("best")).select("shard", F.col("best.elite").alias("bins"))


def placed(items: DataFrame, bins: DataFrame) -> DataFrame:
    """``items`` with the number of their bin in their shard."""
    rows = items.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("item", "size"))).alias("all"))
    return rows.join(bins, "shard").select("shard", F.explode(F.arrays_zip("all", "bins")).alias("x")).select(
        F.col("x.all.item").alias("item"), F.col("x.all.size").alias("size"), "shard", F.col("x.bins").alias("bin")
    )


def pack_pieces(
    pieces: DataFrame, capacity: int, items_per_shard: int = 2048, islands: int = 4, epochs: int = 3,
    generations: int = 25, population: int = 6, full: float = 0.97,
) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with sequence_id and offset.

    A piece that fills a sequence gets it alone. All others are packed by islands in shards of
    about ``items_per_shard``; bins under the share ``full`` of the capacity are dissolved, dealt
    into as many fewer shards, and packed once more. A shard's search ends where the sum of its
    sizes allows no fewer bins; else it takes all ``epochs`` and ``generations``.
    """
    # The row's place in the table tells repeated rows apart; a table read in the same way is packed in the same way.
    named = stored(pieces.withColumn("item", F.struct("doc_id", "piece", F.monotonically_increasing_id().alias("row"))), "pieces")
    small = named.where(F.col("length") < capacity).select("item", F.col("length").cast("int").alias("size"))
    n = small.count()
    shards = max(1, round(n / items_per_shard))
    first = small.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)))
    there = stored(placed(first, on_islands(first, shards, capacity, islands, epochs, generations, population)), "packed")
    filled = there.groupBy("shard", "bin").agg(F.sum("size").alias("sum"))
    slack = there.join(filled, ["shard", "bin"]).withColumn("loose", F.col("sum") < full * capacity)
    loose = slack.where("loose").select("item", "size")
    rest = loose.count()
    fewer = max(1, round(rest / items_per_shard))
    again = loose.withColumn("shard", F.pmod(F.xxhash64("item", F.lit(1)), F.lit(fewer)) + shards)
    done = slack.where("not loose").select("item", "size", "shard", "bin")
    if rest:
        done = done.union(placed(again, on_islands(again, fewer, capacity, islands, epochs, generations, population)).select("item", "size", "shard", "bin"))
    # Numbers of shards and bins make a sequence's; sequences of one full piece count down from -1.
    sequence = F.col("shard").cast("long") * (1 << 32) + F.col("bin")
    before = Window.partitionBy("sequence_id").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    offsets = done.select("item", "size", sequence.alias("sequence_id")).select(
        "item", "sequence_id", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long").alias("offset")
    )
    alone = named.where(F.col("length") >= capacity).select(
        *pieces.columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    joined = named.where(F.col("length") < capacity).join(offsets, "item").select(*pieces.columns, "sequence_id", "offset")
    return joined.union(alone)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece.

    ``vocabulary`` is the path of a byte-level file that every executor has. A null text is
    empty and has its end id only. Repeated rows are documents of their own; a null doc_id stays
    null; other columns are ignored; an empty table gives no rows. Only documents of over
    ``capacity`` ids are cut.
    """
    return pack_pieces(document_pieces(docs, vocabulary, capacity), capacity)
