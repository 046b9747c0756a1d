"""Connected components of a distributed graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import forest, spread_join, stored

LINKS_IN_MEMORY = 200_000


def contracted(links: DataFrame) -> DataFrame:
    """Each partition's links (a, b), replaced by a spanning forest of them.

    Links are folded in as they come, so a task holds one forest of its partition's
    nodes at most; no link between components is lost.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b, size = [], [], 0
        for batch in batches:
            a.append(batch["a"].to_numpy())
            b.append(batch["b"].to_numpy())
            size += len(batch)
            if size > LINKS_IN_MEMORY + 2 * len(a[0]):
                x, y = forest(np.concatenate(a), np.concatenate(b))
                a, b, size = [x], [y], len(x)
        if size:
            x, y = forest(np.concatenate(a), np.concatenate(b))
            yield pd.DataFrame({"a": x, "b": y})

    return links.select("a", "b").mapInPandas(fold, "a long, b long")


def connected_components(links: DataFrame, name: str = "components", rounds: int = 40) -> DataFrame:
    """(node, component) for every node of ``links`` (a long, b long), component the smallest node.

    Alternates a large-star step (a node's larger neighbours move to its smallest one)
    and a small-star step (a node's smaller neighbours do), each after a contraction
    inside the partitions, until all links are stars. Each round is written to the
    shared folder. Nothing is collected but one number a round, and no side of a join,
    each of which has a row for most nodes, is left to broadcast. Raises RuntimeError
    where links aren't stars after ``rounds`` rounds.

    Empty links give no rows; self-links add their node only if it has other links.
    """
    stars = stored(
        contracted(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), name
    )
    for _ in range(rounds):
        both = stored(stars.union(stars.select("b", "a")), name)
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = spread_join(both.where("b > a"), least.hint("merge"), "a", F.col("b")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = contracted(large.where("a <> b").distinct())
        small = large.groupBy("a").agg(F.min("b").alias("low"))
        moved = large.join(small.hint("merge"), "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        stars = stored(moved.union(small.select("a", F.col("low").alias("b"))).distinct(), name)
        # A forest of stars has one link for each node that is not a root, and no root has one.
        state = stars.agg(F.count("*").alias("n"), F.countDistinct("a").alias("nodes")).first()
        if state["n"] == 0:
            break
        if state["n"] == state["nodes"]:
            chained = stars.select(F.col("b").alias("a")).distinct().join(stars.hint("merge"), "a", "left_semi").limit(1).count()
            if not chained:
                break
    else:
        raise RuntimeError(f"{name}: links aren't stars after {rounds} rounds")
    members = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.union(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
