import numpy as np
import pytest

from pairloom.llm.common import forest
from pairloom.llm.vector_dedup import fit_index, needed_slack, unit, vector_components


def brute(rows, threshold=0.93):
    """{position: (n_links, component, kept)} of (vec_id, embedding, label) rows."""
    def fine(r):
        return r[0] is not None and r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    good = [n for n, r in enumerate(rows) if fine(r)]
    x = unit([np.float32(rows[n][1]) for n in good], max(len(rows[n][1]) for n in good))
    label = np.array([rows[n][2] for n in good])
    hit = (x @ x.T >= threshold) & (label[:, None] == label)
    np.fill_diagonal(hit, False)
    ids = np.array([rows[n][0] for n in good])
    i, j = np.nonzero(hit)
    root = dict(zip(*forest(ids[i], ids[j])))
    out = {n: (0, r[0], True) for n, r in enumerate(rows)}
    for p, n in enumerate(good):
        c = root.get(ids[p], ids[p])
        out[n] = (int(hit[p].sum()), int(c), bool(c == ids[p]))
    return out


def test_query_on_a_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_components(frame).collect()}
    want = brute(rows)
    assert got == {r[0]: want[n] for n, r in enumerate(rows)}


def test_recall_at_the_threshold():
    rng = np.random.default_rng(5)
    x = unit(rng.normal(size=(3000, 32)).tolist(), 32)
    index = fit_index(x, 8, 0.93, 0.99)
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    y = 0.94 * x + np.sqrt(1 - 0.94**2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    found = np.mean([c in walk for c, walk in zip(index.cells(y), index.visited(x))])
    assert found >= 0.98
    walk = index.visited(x[:1])[0]
    assert walk[0] == index.cells(x[:1])[0] and len(walk) == len(set(walk))


def low_rank(rng, n, rank, size=64):
    """Vectors of a subspace, with an equal number of close partners of some of them in it."""
    basis = np.linalg.qr(rng.normal(size=(size, rank)))[0]
    x = rng.normal(size=(n // 2, rank))
    near = x[rng.integers(0, n // 2, n - n // 2)]
    noise = rng.normal(size=near.shape) * np.linalg.norm(near, axis=1, keepdims=True) * 0.3 / np.sqrt(rank)
    return np.float32(np.concatenate([x, near + noise]) @ basis.T)


@pytest.mark.parametrize("rank, k", [(4, 64), (8, 64), (4, 256), (8, 256)])
def test_recall_on_vectors_of_low_rank(rank, k):
    rng = np.random.default_rng(rank + k)
    x = unit(low_rank(rng, 8192, rank).tolist(), 64)
    index = fit_index(x, k, 0.93, 0.9999)
    i, j = np.nonzero(np.triu(x[:2000] @ x.T >= 0.93, 1))
    few = rng.choice(len(i), min(len(i), 20_000), replace=False)
    assert np.mean(needed_slack(index, x[i[few]], x[j[few]]) <= index.slack) >= 0.999


@pytest.mark.parametrize("rank", [4, 8])
def test_links_of_a_table_of_low_rank(spark, rank):
    rng = np.random.default_rng(rank)
    x = low_rank(rng, 12_000, rank)
    rows = [(n, v.tolist(), n % 2) for n, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(8)
    got = vector_components(frame, per_cell=16).collect()
    want = brute(rows)
    links = sum(n for n, _, _ in want.values())
    assert links > 10_000 and sum(r.n_links for r in got) >= 0.999 * links
    assert all(r.n_links <= want[r.vec_id][0] for r in got)


def test_odd_rows_and_a_hot_group(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=6)
    rows = [(i, (base + 0.01 * rng.normal(size=6)).tolist(), 1) for i in range(100, 160)]
    rows += [(i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0], 2) for i in range(200, 230)] + [(7, [1.0, 0.0], 2), (300, [1.0, 0.0], 3)]
    rows += [(1, None, 1), (2, [], 1), (3, [0.0] * 6, 1), (4, [1.0, None], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1), (8, base.tolist(), None)]
    rows += [(400, [0.0, 3e38], 4), (400, [0.0, 3e38], 4), (401, [0.0, 1e-38], 4)]
    frame = spark.createDataFrame([(*r, 9, 9) for r in rows], "vec_id long, embedding array<float>, label int, key int, copies int")
    got = sorted(tuple(r) for r in vector_components(frame).collect())
    assert got == sorted((r[0], *brute(rows)[n]) for n, r in enumerate(rows))
    assert vector_components(frame.where("false")).count() == 0
    none = [tuple(r) for r in vector_components(frame.where("label is null")).collect()]
    assert none == [(8, 0, 8, True)]


def test_cut_cells_and_salted_copies_lose_no_link(spark, monkeypatch):
    from pairloom.llm import common, vector_dedup

    monkeypatch.setattr(vector_dedup, "BASE_BLOCK", 8)
    monkeypatch.setattr(vector_dedup, "QUERY_BLOCK", 16)
    monkeypatch.setattr(common, "ROWS_TOGETHER", 5)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    rng = np.random.default_rng(8)
    base = rng.normal(size=8)
    rows = [(i, (base + 0.3 * rng.normal(size=8)).tolist(), 1) for i in range(150)]
    rows += [(i, base.tolist(), 1) for i in range(200, 240)] + [(i, None, 1) for i in range(300, 330)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(tuple(r) for r in vector_components(frame, recall=1.0, per_cell=16).collect())
    assert got == sorted((r[0], *brute(rows)[n]) for n, r in enumerate(rows))


def test_query_equals_its_sql(spark):
    import duckdb

    from pairloom.llm.queries import ORACLE_SQL, QUERIES

    duck = duckdb.connect()
    duck.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    want = duck.execute(ORACLE_SQL["op1_vector_dedup"]).fetchall()
    got = QUERIES["op1_vector_dedup"](spark, "/root/testdata/sf0.01").select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(want)
