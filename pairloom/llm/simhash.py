"""SimHash near-duplicates found by covering locality-sensitive hashing.

The fingerprint of a text has a bit for each bit position that is set in over half
of its shingle hashes. Two fingerprints within the radius r share the masked value of
at least one of 2^(r+1) - 1 masks: every bit position is given a vector of r + 1 bits,
mask v keeps the positions whose vector has an odd product with v. For any r positions
that differ there is a v that is orthogonal to all of their vectors, so no pair within
the radius is missed, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import bounded_batches, byte_text, forest, in_blocks, sliced, spread_join, stored
from pairloom.llm.components import connected_components

BLOCK = 512
#: Links that a comparison holds before it folds them.
LINKS_HELD = 200_000


def covering_masks(radius: int, seed: int = 7) -> list[int]:
    """The 64-bit masks, as signed longs; a fixed deal of vectors gives about 32 bits each."""
    size = 1 << (radius + 1)
    vectors = np.resize(np.arange(1, size), 64)
    np.random.default_rng(seed).shuffle(vectors)
    masks = []
    for v in range(1, size):
        bits = [int(x) for x in np.bitwise_count(vectors & v) & 1]
        value = sum(bit << i for i, bit in enumerate(bits))
        masks.append(value - (1 << 64) if value >> 63 else value)
    return masks


def shingle_hashes(data: bytes, words_per_shingle: int) -> tuple[bytes, np.ndarray]:
    """The words of one text, joined by blanks, and the hashes of its shingles, repeats included.

    A-Z are lower-cased and words are split at ASCII white space; fewer words than a
    shingle has make one shingle, and no word gives none.
    """
    words = data.lower().split()
    joined = b" ".join(words)
    if not words:
        return joined, np.zeros(0, np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    stops = ends[min(words_per_shingle, len(words)) - 1:]
    starts = np.concatenate([[0], ends[: len(stops) - 1] + 1])
    digest = xxhash.xxh64_intdigest
    return joined, np.fromiter((digest(joined[i:j], 42) for i, j in zip(starts.tolist(), stops.tolist())), np.uint64, len(stops))


def hashes_fingerprint(hashes: np.ndarray) -> int:
    """The fingerprint of shingles, unsigned; zero of none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at: at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def text_fingerprint(data: bytes, words_per_shingle: int = 4) -> int:
    """The fingerprint of one text, unsigned; see :func:`shingle_hashes`. No word gives zero."""
    return hashes_fingerprint(shingle_hashes(data, words_per_shingle)[1])


def fingerprints(docs: DataFrame, words_per_shingle: int = 4) -> DataFrame:
    """(doc_id, fp long) of each row; a null text is empty and has fingerprint zero."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            values = [text_fingerprint(x.as_py(), words_per_shingle) for x in batch.column(1)]
            signed = np.array(values, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed)], ["doc_id", "fp"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), byte_text().alias("data")).mapInArrow(
        of, "doc_id long, fp long"
    )


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of bits that differ. Bits are counted unsigned: of a signed number, numpy counts those of its absolute value."""
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64))


def near_links(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between ``values`` at ``radius`` or fewer differing bits.

    Links are folded into the forest as they come, so no more than a few hundred thousand are held.
    """
    node, root = values[:0], values[:0]
    left, right, held = [], [], 0
    rows = max(1, LINKS_HELD // max(1, len(values)))
    for at in range(0, len(values) - 1, rows):
        some = values[at: at + rows]
        i, j = np.nonzero(differing(some[:, None], values[None, at + 1:]) <= radius)
        later = j >= i
        left.append(some[i[later]])
        right.append(values[at + 1 + j[later]])
        held += len(left[-1])
        if held > LINKS_HELD:
            node, root = forest(np.concatenate([node, *left]), np.concatenate([root, *right]))
            left, right, held = [], [], 0
    return forest(np.concatenate([node, *left]), np.concatenate([root, *right]))


def whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(g, fp) of the sorted rows of ``batches``, in runs that end where a group does."""
    keys, values = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        keys, values = np.concatenate([keys, batch["g"].to_numpy()]), np.concatenate([values, batch["fp"].to_numpy()])
        done = np.searchsorted(keys, keys[-1]) if len(keys) else 0
        if done:
            yield keys[:done], values[:done]
            keys, values = keys[done:], values[done:]
    if len(keys):
        yield keys, values


def fingerprint_links(values: DataFrame, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp``, enough to span every component.

    Each fingerprint goes to a bucket for each mask. Buckets of one are dropped after a
    count; a bucket of over ``block`` fingerprints is cut into blocks by hash, and each pair
    of its blocks is a group of its own, so no task holds a whole hot bucket. Pairs are
    compared inside the task, which returns a spanning forest and never the pairs.
    Spark takes the size of the exploded table for that of ``values``, so no join with
    it is left to broadcast.
    """
    table = F.posexplode(F.array(*[F.lit(m) for m in covering_masks(radius)]))
    keyed = values.select("fp", table.alias("t", "mask")).select("fp", "t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    full = keyed.join(sizes.hint("merge"), ["t", "key"]).withColumn("nb", in_blocks(F.col("n"), block))
    own = F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int")
    pairs = full.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    grouped = pairs.select(
        F.xxhash64("t", "key", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "fp"
    )
    # A shared hash of two groups only puts them into one: it adds comparisons and no false link.
    dealt = grouped.repartition("g").sortWithinPartitions("g", "fp")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in whole_groups(batches):
            bounds = np.flatnonzero(np.diff(group[0], prepend=group[0][0] - 1, append=group[0][-1] + 1))
            sizes = np.diff(bounds)
            # All pairs of adjacent groups of two are compared at once, larger groups one after the other.
            two = bounds[:-1][sizes == 2]
            near = differing(group[1][two], group[1][two + 1]) <= radius
            yield pd.DataFrame({"a": group[1][two][near], "b": group[1][two + 1][near]})
            for start, size in zip(bounds[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                node, root = near_links(group[1][start: start + size], radius)
                yield pd.DataFrame({"a": node, "b": root})

    return dealt.mapInPandas(compare, "a long, b long")


def simhash_components(docs: DataFrame, radius: int = 4, words_per_shingle: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of ``docs``.

    Documents link at ``radius`` or fewer differing bits; component_id is the smallest
    doc_id that links reach. Equal fingerprints are one node of the graph, so a group of
    copies of any size costs one row after a pre-aggregated count. Null and empty texts
    have fingerprint zero and link like any other. Repeated rows stay; a null doc_id keeps
    its row, and takes its component from the others. An empty table gives no rows; other
    columns are ignored.
    """
    prints = stored(fingerprints(docs, words_per_shingle), "simhash")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    parts = connected_components(fingerprint_links(nodes.select("fp"), radius), "simhash-links")
    tied = nodes.join(parts.hint("merge"), nodes["fp"] == parts["node"], "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")
    )
    lowest = tied.groupBy("component").agg(F.min("first").alias("component_id"))
    named = tied.join(lowest.hint("merge"), "component").select("fp", "component_id")
    return spread_join(prints, named.hint("merge"), "fp", F.coalesce("doc_id", F.lit(0))).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
