import numpy as np
import pytest

from pairloom.llm.common import forest
from pairloom.llm.components import connected_components


def test_long_chain_and_random_graph(spark):
    rng = np.random.default_rng(8)
    chain = rng.permutation(3000).astype(np.int64)
    a = np.concatenate([chain[:-1], rng.integers(10_000, 12_000, 1500), [99_999, 5]])
    b = np.concatenate([chain[1:], rng.integers(10_000, 12_000, 1500), [99_999, 5]])
    links = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a long, b long").repartition(7)
    got = {r.node: r.component for r in connected_components(links).collect()}
    node, root = forest(a, b)
    want = dict(zip(node.tolist(), root.tolist()))
    want |= {r: r for r in want.values()}
    assert got == want
    assert connected_components(links.where("false")).count() == 0


def test_a_hub_with_many_links(spark):
    links = spark.range(1, 20_000).selectExpr("id as a", "0L as b").unionByName(spark.range(20_001, 20_500).selectExpr("id as a", "id - 1 as b"))
    got = connected_components(links)
    assert got.where("component = 0").count() == 20_000
    assert got.where("component = 20000").count() == 500


def test_rounds_that_run_out_are_an_error(spark):
    chain = np.random.default_rng(9).permutation(3000)
    links = spark.createDataFrame([(int(x), int(y)) for x, y in zip(chain[:-1], chain[1:])], "a long, b long").repartition(7)
    with pytest.raises(RuntimeError):
        connected_components(links, rounds=0)
