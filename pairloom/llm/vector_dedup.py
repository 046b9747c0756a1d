"""Near-duplicate vectors found through an inverted multi-index.

Each half of the unit vectors has a codebook of its own; pairs of codewords form the
product grid whose cells hold the vectors. A vector visits the cells in the order of its
distance to them (the multi-sequence walk over both codebooks' sorted distances) and stops
at the slack that finds the wanted share of partners at the threshold. What it meets is
verified by cosine in double precision.
"""

from __future__ import annotations

import heapq
import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import forest, in_blocks, joined_small, spread_join, stored
from pairloom.llm.components import connected_components

LOG = logging.getLogger(__name__)
BASE_BLOCK, QUERY_BLOCK = 2048, 4096
#: Steps of the measured slack.
SLACKS = 1024


def unit(rows: list, size: int) -> np.ndarray:
    """The rows as unit vectors in double precision; shorter rows are padded with zeros."""
    out = np.zeros((len(rows), size))
    for n, row in enumerate(rows):
        out[n, : len(row)] = row
    # Dividing by the largest component first keeps squares from overflowing.
    out /= np.abs(out).max(1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def codewords(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k-means of ``x``."""
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = squares(x, c).argmin(1)
        size = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
    return c


@dataclass
class MultiIndex:
    """Two codebooks over the halves of vectors of ``size`` components, and the walk's slack."""

    size: int
    first: np.ndarray
    second: np.ndarray
    slack: float = 0.0

    def parts(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        half = (self.size + 1) // 2
        return zip((x[:, :half], x[:, half:]), (self.first, self.second))

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The grid cell of each vector."""
        a, b = (squares(part, words).argmin(1) for part, words in self.parts(x))
        return a * len(self.second) + b

    def margins(self, x: np.ndarray) -> list[np.ndarray]:
        """For each half, the squared distance of each vector to the border of each codeword's region."""
        out = []
        for part, words in self.parts(x):
            d = squares(part, words)
            own = d.argmin(1)
            gap = 2 * np.sqrt(squares(words, words))[own]
            out.append(np.where(gap > 0, (d - d.min(1, keepdims=True)) / np.maximum(gap, 1e-12), 0) ** 2)
        return out

    def visited(self, x: np.ndarray) -> list[list[int]]:
        """The cells that each vector visits, nearest first."""
        first, second = self.margins(x)
        order_a, order_b = first.argsort(1, kind="stable"), second.argsort(1, kind="stable")
        sorted_a, sorted_b = np.take_along_axis(first, order_a, 1), np.take_along_axis(second, order_b, 1)
        return [self.walk(*rows) for rows in zip(sorted_a.tolist(), sorted_b.tolist(), order_a.tolist(), order_b.tolist())]

    def walk(self, near_a: list, near_b: list, names_a: list, names_b: list) -> list[int]:
        """Multi-sequence traversal: pairs of places by the sum of their margins, up to the slack."""
        out, width = [], len(self.second)
        front = [(near_a[0] + near_b[0], 0, 0)]
        while front:
            total, i, j = heapq.heappop(front)
            if total > self.slack:
                break
            out.append(names_a[i] * width + names_b[j])
            if j + 1 < len(near_b):
                heapq.heappush(front, (near_a[i] + near_b[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(near_a):
                heapq.heappush(front, (near_a[i + 1] + near_b[0], i + 1, 0))
        return out


def partners(base: np.ndarray, noise: np.ndarray, threshold: float) -> np.ndarray:
    """Unit vectors at exactly the threshold's angle from those of ``base``, in the directions of ``noise``."""
    noise = noise - (noise * base).sum(1, keepdims=True) * base
    length = np.linalg.norm(noise, axis=1, keepdims=True)
    return threshold * base + np.sqrt(1 - threshold**2) * noise / np.maximum(length, 1e-12)


def needed_slack(index: MultiIndex, base: np.ndarray, partner: np.ndarray) -> np.ndarray:
    """The slack at which the walk of each vector of ``base`` gets to its partner's cell."""
    first, second = index.margins(base)
    cell, every = index.cells(partner), np.arange(len(base))
    return first[every, cell // len(index.second)] + second[every, cell % len(index.second)]


def fit_index(x: np.ndarray, k: int, threshold: float, recall: float, seed: int = 3) -> MultiIndex:
    """Codebooks of ``k`` words from the sample ``x``, and a slack that reaches ``recall`` on made partners.

    Those are drawn at exactly the threshold's angle from sampled vectors, the hardest that have to be found: in random
    directions, and in the directions in which sampled vectors differ, as vectors of low rank have partners there only.
    A ``recall`` of 1 takes the bound that no pair can exceed: a partner in another region is at
    least as far away as its border.
    """
    rng = np.random.default_rng(seed)
    half = (x.shape[1] + 1) // 2
    k = min(k, len(x))
    index = MultiIndex(x.shape[1], codewords(x[:, :half], k, rng), codewords(x[:, half:], k, rng))
    index.slack = 2 - 2 * threshold + 1e-9
    if recall >= 1:
        return index
    base = x[rng.integers(0, len(x), 20_000)]
    noises = rng.normal(size=base.shape), x[rng.integers(0, len(x), 20_000)] - x[rng.integers(0, len(x), 20_000)]
    made = [float(np.quantile(needed_slack(index, base, partners(base, noise, threshold)), recall)) for noise in noises]
    index.slack = min(index.slack, max(made) + 1e-12)
    return index


def with_measured_slack(index: MultiIndex, entries: DataFrame, queries: list, threshold: float, recall: float) -> tuple[MultiIndex, int, float]:
    """``index`` with its slack raised until it finds the real partners of ``queries``; their number, and the share it then finds.

    ``queries`` (label, key, embedding) are compared with all ``entries`` of their labels, in blocks. What comes back is a histogram
    of the slacks that their links need. The slack is the least at which the found share's lower 95 % bound (Wilson's)
    reaches ``recall``; where there are too few links to say so, it is that of the farthest one.
    """
    most = 2 - 2 * threshold + 1e-9
    by_label: dict = {}
    for q in queries:
        by_label.setdefault(q["label"], []).append(q)
    own = {label: (np.array([q["key"] for q in rows]), unit([q["embedding"] for q in rows], index.size)) for label, rows in by_label.items()}
    shared = entries.sparkSession.sparkContext.broadcast((index, own))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, own = shared.value
        counts = np.zeros(SLACKS + 1, np.int64)
        margins = {label: index.margins(x) for label, (_, x) in own.items()}
        for batch in batches:
            for label, rows in batch.groupby("label"):
                if label not in own:
                    continue
                keys, x = own[label]
                first, second = margins[label]
                for at in range(0, len(rows), BASE_BLOCK):
                    part = rows.iloc[at: at + BASE_BLOCK]
                    y = unit(part["embedding"].tolist(), index.size)
                    i, j = np.nonzero((x @ y.T >= threshold) & (keys[:, None] != part["key"].to_numpy()))
                    cell = index.cells(y)[j]
                    needed = first[i, cell // len(index.second)] + second[i, cell % len(index.second)]
                    np.add.at(counts, np.minimum(np.ceil(needed / most * SLACKS).astype(int), SLACKS), 1)
        yield pd.DataFrame({"bin": np.arange(SLACKS + 1), "n": counts})

    found = entries.select("label", "key", "embedding").mapInPandas(measure, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SLACKS + 1, np.int64)
    for r in found:
        counts[r["bin"]] = r["n"]
    links, reached = int(counts.sum()), np.cumsum(counts)
    if not links:
        return index, 0, 1.0
    z = 1.645
    share = reached / links
    low = (share + z * z / (2 * links) - z * np.sqrt(share * (1 - share) / links + z * z / (4 * links**2))) / (1 + z * z / links)
    enough = np.flatnonzero(low >= recall) if low[-1] >= recall else np.flatnonzero(reached == links)
    index.slack = min(most, max(index.slack, enough[0] / SLACKS * most + 1e-12))
    return index, links, float(share[min(SLACKS, int(index.slack / most * SLACKS))])


def compare_cell(rows: pd.DataFrame, size: int, threshold: float) -> pd.DataFrame:
    """One block of a cell: for each query the linked copies it met, and links that span what it met."""
    base, query = rows[rows["role"] == 0], rows[rows["role"] == 1]
    columns = ["key", "n", "a", "b"]
    if base.empty or query.empty:
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in columns})
    b, q = unit(base["embedding"].tolist(), size), unit(query["embedding"].tolist(), size)
    keys, ids, copies = base["key"].to_numpy(), base["id"].to_numpy(), base["copies"].to_numpy()
    own_keys, own_ids = query["key"].to_numpy(), query["id"].to_numpy()
    counts, left, right = np.zeros(len(q), np.int64), own_ids[:0], own_ids[:0]
    for at in range(0, len(q), 512):
        hit = (q[at: at + 512] @ b.T >= threshold) & (own_keys[at: at + 512, None] != keys)
        counts[at: at + 512] = hit @ copies
        i, j = np.nonzero(hit)
        left, right = forest(np.concatenate([left, own_ids[at + i]]), np.concatenate([right, ids[j]]))
    met = counts > 0
    out = pd.DataFrame({"key": own_keys[met], "n": counts[met], "a": -1, "b": -1})
    return pd.concat([out, pd.DataFrame({"key": 0, "n": 0, "a": left, "b": right})])[columns]


def vector_components(
    vectors: DataFrame, threshold: float = 0.93, recall: float = 0.9999, sample: int = 8192, per_cell: int = 512, measured: int = 512
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of (vec_id, embedding, label).

    Vectors of equal label link at a cosine of ``threshold`` or more. Null, empty and zero
    vectors, those with null or non-finite components, and rows of null label or id link with
    nothing: 0 links, their own component, kept. A shorter vector counts as padded with zeros.
    Repeated rows are vectors of their own that link with one another. Equal vectors of a
    label are one entry of the index with a number of copies, and a cell with many entries is
    cut into blocks, so no task gathers a hot group. An empty table gives no rows; other
    columns are ignored.

    ``sample`` bounds the vectors that the codebooks are fitted on, those of the smallest
    hash; ``per_cell`` is the wanted mean number of a label's vectors in a cell, which sets the
    codebooks' size from the exact counts: bringing a vector to a cell costs about as much as
    comparing it with so many, so smaller cells cost more visits than they save comparisons.
    ``recall`` is the walk's target on made partners and on the real ones of ``measured`` vectors, compared with all
    vectors of their labels; at 1 no link is missed, for many more visits.
    """
    entry = vectors.select("vec_id", "embedding", "label")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & fine
    usable = usable & F.exists("embedding", lambda x: x != 0)
    # Two hashes of 64 bits and the label name a vector; equal vectors have equal names.
    marked = entry.withColumn("usable", F.coalesce(usable, F.lit(False))).withColumn(
        "key", F.when(F.col("usable"), F.xxhash64("label", "embedding"))
    ).withColumn("key2", F.when(F.col("usable"), F.xxhash64(F.lit("second"), "embedding", "label")))
    entries = stored(
        marked.where("usable").groupBy("key", "key2").agg(
            F.min("vec_id").alias("id"), F.count("*").alias("copies"),
            F.first("label").alias("label"), F.first("embedding").alias("embedding"),
        ), "vectors",
    )
    facts = entries.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("size")).agg(
        F.max("n").alias("n"), F.max("size").alias("size")
    ).first()
    own = F.col("vec_id")
    if not facts["n"]:
        return vectors.select(own, F.lit(0).cast("long").alias("n_links"), own.cast("long").alias("component_id"), F.lit(True).alias("kept"))
    size = facts["size"]
    k = int(min(1024, max(2, round((facts["n"] / per_cell) ** 0.5))))
    drawn = entries.select("label", "key", "embedding", F.xxhash64("key", "key2").alias("h")).orderBy("h").limit(sample).collect()
    index = fit_index(unit([r["embedding"] for r in drawn], size), k, threshold, recall)
    if recall < 1:
        index, links, share = with_measured_slack(index, entries, drawn[:measured], threshold, recall)
        LOG.info("slack %.4f finds %.5f of %d links of %d vectors", index.slack, share, links, min(measured, len(drawn)))

    def enter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.iloc[at: at + 2000]
                x = unit(part["embedding"].tolist(), index.size)
                walks = index.visited(x)
                yield part.assign(cell=index.cells(x), role=0)
                yield part.loc[part.index.repeat([len(w) for w in walks])].assign(cell=[c for w in walks for c in w], role=1)

    columns = ["label", "key", "id", "copies", "embedding"]
    schema = ", ".join(f"{c} {entries.schema[c].dataType.simpleString()}" for c in columns) + ", cell long, role int"
    entered = stored(entries.select(*columns).mapInPandas(enter, schema), "multi-index")
    sizes = stored(
        entered.groupBy("label", "cell").agg(
            F.count_if(F.col("role") == 0).alias("held"), F.count_if(F.col("role") == 1).alias("asked")
        ).where("held > 0"), "cells",
    )
    blocks = joined_small(entered, sizes, ["label", "cell"]).withColumn("nb", in_blocks(F.col("held"), BASE_BLOCK)).withColumn(
        "nq", F.greatest(F.lit(1), in_blocks(F.col("asked"), QUERY_BLOCK))
    )
    is_base = F.col("role") == 0
    own_block = F.pmod("key", F.when(is_base, F.col("nb")).otherwise(F.col("nq")))
    others = F.sequence(F.lit(0), F.when(is_base, F.col("nq")).otherwise(F.col("nb")) - 1)
    dealt = blocks.withColumn("own", own_block).withColumn("other", F.explode(others)).select(
        "label", "cell", F.when(is_base, F.col("own")).otherwise(F.col("other")).alias("bb"),
        F.when(is_base, F.col("other")).otherwise(F.col("own")).alias("qb"), "role", "key", "id", "copies", "embedding",
    )
    # Dealt by all four columns: a join's partitions by label and cell would keep a cell's blocks together.
    group = ["label", "cell", "bb", "qb"]
    met = stored(
        dealt.repartition(*group).groupBy(*group).applyInPandas(
            lambda rows: compare_cell(rows, size, threshold), "key long, n long, a long, b long"
        ), "vector-links",
    )
    links = met.where("n > 0").groupBy("key").agg(F.sum("n").alias("n"))
    # An entry with copies is joined to its smallest id even if it meets nothing else.
    parts = connected_components(met.where("n = 0").select("a", "b"), "vector-components")
    named = entries.join(links, "key", "left").join(parts, entries["id"] == parts["node"], "left").select(
        "key", "key2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")
    )
    # Rows without a key link with nothing and take no part in the join; a hot key is one vector's copies.
    keyed = stored(marked.select("vec_id", "key", "key2"), "vector-keys")
    row = F.monotonically_increasing_id()
    linked = spread_join(keyed.where("key is not null"), named, ["key", "key2"], row).select("vec_id", "n_links", "component")
    alone = keyed.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component"))
    component = F.col("component").cast("long")
    return linked.union(alone).select(
        "vec_id", F.col("n_links").cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
