"""Near-duplicates by the Jaccard similarity of word shingles, found by SimHash and by MinHash bands and confirmed on the shingles.

Texts whose SimHash fingerprints links join (RADIUS differing bits, covering masks) are compared, whatever their bands.

A band is a hash of ROWS minima; two texts of similarity j share one of BANDS with the chance
1 - (1 - j^ROWS)^BANDS: 0.99997 at 0.8 and more above. Links are only those whose similarity,
counted on the shingles themselves, reaches the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import bounded_batches, byte_text, forest, in_blocks, sliced, spread_join, stored
from pairloom.llm.components import connected_components
from pairloom.llm.simhash import fingerprint_links, hashes_fingerprint, shingle_hashes

BANDS, ROWS, BLOCK, RADIUS = 20, 4, 512, 4
#: Bits of the filter that spares texts in no bucket the shuffle; any number is right, as the join decides.
MARKS = 1 << 22
#: Marks of the comparison of two sets, and bytes of shingles in a block.
SHARED_MARKS, BLOCK_BYTES = 1 << 20, 32_000_000
FACTORS = np.random.default_rng(11).integers(1 << 62, size=(2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_hash(joined: bytes) -> tuple[int, int]:
    """Two hashes of a text's words: the node's number, and one that tells apart texts of equal numbers."""
    return xxhash.xxh64_intdigest(joined, 1), xxhash.xxh3_64_intdigest(joined, 2)


def shingle_set(data: bytes, words_per_shingle: int = 5) -> tuple[tuple[int, int], np.ndarray]:
    """The hashes of the text's words and the sorted distinct hashes of its shingles.

    A-Z are lower-cased and words are split at ASCII white space; fewer words than a
    shingle has make one shingle, and no word gives none.
    """
    joined, hashes = shingle_hashes(data, words_per_shingle)
    return words_hash(joined), np.unique(hashes)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """The signed key of each band of a text with shingles."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 4096):
        mixed = shingles[at: at + 4096, None] * FACTORS[0]
        mixed ^= mixed >> np.uint64(32)
        mixed *= FACTORS[1]
        least = np.minimum(least, mixed.min(0))
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], np.uint64).view(np.int64)


def row_hash(docs: DataFrame) -> Column:
    """Two hashes, as a struct, of all of a row's columns; equal rows have the same."""
    own = [*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"`{c}`").isNull() for c in docs.columns]]
    return F.struct(F.xxhash64(*own).alias("first"), F.xxhash64(F.lit("second"), *reversed(own)).alias("second"))


def similar(sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of sets whose Jaccard similarity is ``threshold`` or more, enough to span every component of such pairs.

    Sets that links join already aren't compared, nor those whose sizes differ too much. How many members a set may share with
    another one is first counted on marks of their hashes, which can only be too many.
    """
    size, label = np.array([len(s) for s in sets]), np.arange(len(sets))
    marks, left, right = np.zeros(SHARED_MARKS, bool), [], []
    for i in range(len(sets) - 1):
        near = (size[i + 1:] >= threshold * size[i] - 1e-9) & (threshold * size[i + 1:] <= size[i] + 1e-9)
        rest = i + 1 + np.flatnonzero(near & (label[i + 1:] != label[i]))
        if not len(rest):
            continue
        own = sets[i] & np.uint64(SHARED_MARKS - 1)
        marks[own] = True
        for j in rest.tolist():
            least = threshold / (1 + threshold) * (size[i] + size[j]) - 1e-6
            if label[i] == label[j] or np.count_nonzero(marks[sets[j] & np.uint64(SHARED_MARKS - 1)]) < least:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both >= threshold * (size[i] + size[j] - both) - 1e-9:
                left.append(i)
                right.append(j)
                label[label == label[j]] = label[i]
        marks[own] = False
    return np.array(left, int), np.array(right, int)


def with_simhash(texts: DataFrame) -> DataFrame:
    """(node, bands, size) of ``texts`` (with fp, too): the component of a text's fingerprint is one more band."""
    parts = stored(connected_components(fingerprint_links(texts.select("fp").distinct(), RADIUS), "simhash-links"), "simhash-parts")
    near = F.coalesce("component", "fp")
    return texts.join(parts.hint("merge"), texts["fp"] == parts["node"], "left").select(texts["node"], F.concat("bands", F.array(near)).alias("bands"), "size")


def bucket_groups(texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, g): the groups in which the nodes of ``texts`` (node, bands, size) are to be compared.

    Bands' buckets of one are dropped after a count, buckets of the same nodes are one, and those of over ``block`` nodes
    or BLOCK_BYTES bytes of shingles are cut into blocks, each pair of which is a group of its own.
    """
    keyed = texts.select("node", "size", F.posexplode("bands").alias("band", "key"))
    sizes = keyed.groupBy("band", "key").agg(F.count("*").alias("n"), (8 * F.sum("size")).alias("bytes"), F.bit_xor(F.xxhash64("node")).alias("bucket")).where("n > 1")
    blocks = F.greatest(in_blocks(F.col("n"), block), in_blocks(F.col("bytes"), BLOCK_BYTES))
    full = keyed.select("node", "band", "key").join(sizes, ["band", "key"]).select("node", "bucket", blocks.alias("nb")).distinct()
    pairs = full.withColumn("own", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    pairs = pairs.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return pairs.select("node", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("g"))


def jaccard_links(grouped: DataFrame, shingles: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between nodes of one group of ``grouped`` (node, g), enough to span every component.

    ``shingles`` has (node, shingles) of those nodes at least. Pairs are compared inside the task.
    """
    dealt = grouped.join(shingles, "node").repartition("g").sortWithinPartitions("g")

    def links_of(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        rows = rows.drop_duplicates("node")
        if len(rows) < 2:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        nodes = rows["node"].to_numpy()
        i, j = similar([np.frombuffer(x, np.uint64) for x in rows["shingles"]], threshold)
        return forest(nodes[i], nodes[j])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for batch in batches:
            for g, rows in batch.groupby("g", sort=True):
                if held and held[0]["g"].iloc[0] != g:
                    node, root = links_of(pd.concat(held))
                    yield pd.DataFrame({"a": node, "b": root})
                    held = []
                held.append(rows)
        if held:
            node, root = links_of(pd.concat(held))
            yield pd.DataFrame({"a": node, "b": root})

    return dealt.mapInPandas(compare, "a long, b long")


def jaccard_components(docs: DataFrame, threshold: float = 0.8, words_per_shingle: int = 5) -> DataFrame:
    """(doc_id, row, node, component, alone) of each row of ``docs``: its hashes, that of its words, and the least node that links reach.

    Texts of the same words are one node; a null text is empty. Repeated rows and null ids stay. ``alone``
    is a second hash of the words where the node has no link, else 0: texts are of one group if
    they have the same component and the same ``alone``.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [shingle_hashes(x.as_py(), words_per_shingle) for x in batch.column(2)]
            sets = [(words_hash(joined), np.unique(hashes)) for joined, hashes in texts]
            prints = np.array([hashes_fingerprint(hashes) for _, hashes in texts], np.uint64).view(np.int64)
            nodes, checks = np.array([node for node, _ in sets], np.uint64).reshape(-1, 2).T.copy().view(np.int64)
            bands = pa.array([band_keys(s) if len(s) else [] for _, s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(nodes), pa.array(checks), bands, pa.array([len(s) for _, s in sets], pa.int64()), pa.array(prints)], ["doc_id", "row", "node", "check", "bands", "size", "fp"])

    bounded_batches(docs.sparkSession)
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash(docs).alias("row"), byte_text().alias("data"))
    found = stored(kept.mapInArrow(of, "doc_id long, row struct<first:long,second:long>, node long, check long, bands array<long>, size long, fp long"), "bands")
    texts = found.where("size > 0").select("node", "bands", "size", "fp").dropDuplicates(["node"])
    grouped = stored(bucket_groups(with_simhash(texts)), "buckets")
    marks = np.zeros(MARKS, bool)
    marks[grouped.select(F.pmod("node", F.lit(MARKS)).cast("int").alias("m")).distinct().toPandas()["m"].to_numpy(np.int64)] = True
    marks = docs.sparkSession.sparkContext.broadcast(np.packbits(marks))

    def shingles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.unpackbits(marks.value)
        for batch in sliced(batches):
            nodes, sets = [], []
            for x in batch.column(0):
                data = x.as_py()
                node = words_hash(b" ".join(data.lower().split()))[0]
                if marked[node % MARKS]:
                    nodes.append(node)
                    sets.append(shingle_set(data, words_per_shingle)[1].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sets, pa.binary())], ["node", "shingles"])

    shingles = docs.select(byte_text().alias("data")).mapInArrow(shingles_of, "node long, shingles binary").dropDuplicates(["node"])
    parts = connected_components(jaccard_links(grouped, shingles, threshold), "jaccard-links")
    rows = found.select("doc_id", "row", "node", "check")
    alone = F.when(F.col("component").isNull(), F.col("check")).otherwise(0)
    return spread_join(rows, parts, "node", F.col("row"), "left").select("doc_id", "row", "node", F.coalesce("component", "node").alias("component"), alone.alias("alone"))
