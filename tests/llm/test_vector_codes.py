import hashlib
from collections import defaultdict

import numpy as np
import pytest

from pairloom.llm import vector_codes as vc
from pairloom.llm.queries import QUERIES

KINDS = "vec_id long, embedding array<float>, label int, x int, code string, error int"


def fine(v):
    return v is not None and all(c is not None and np.isfinite(c) for c in v)


def brute(rows, parts=16, entries=64, rounds=2, scale=256):
    """Sorted (vec_id, code, error, label_error, sha256) of (vec_id, vector, label) rows, in Python's integers."""
    kept = [r for r in rows if fine(r[1])]
    size = max(len(r[1]) for r in kept)
    size = max(parts, -(-size // parts) * parts)

    def whole(v):
        return [min(max(int(np.floor(scale * np.float64(np.float32(c)))), -(1 << 63)), (1 << 63) - 1) for c in v] + [0] * (size - len(v))

    xs = [whole(r[1]) for r in kept]
    width = size // parts
    cut = [[x[p * width: (p + 1) * width] for p in range(parts)] for x in xs]
    first = sorted(range(len(kept)), key=lambda n: (kept[n][0] is None, kept[n][0] or 0, xs[n]))[:entries]
    books = [[cut[n][p] for n in first] for p in range(parts)]

    def near(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            sums = defaultdict(list)
            for c in cut:
                sums[near(p, c[p])[1]].append(c[p])
            books[p] = [[sum(v) // len(v) for v in zip(*sums[k])] if k in sums else e for k, e in enumerate(books[p])]
    found = [[near(p, c[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    labels = defaultdict(int)
    for r, e in zip(kept, errors):
        labels[r[2]] += e
        labels[r[2]] = float("inf") if e >= 10**38 else labels[r[2]]

    def shown(number):
        return int(number) if number < 10**38 else None

    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{k:02x}" for _, k in f), shown(e), shown(labels[r[2]]), digest) for r, f, e in zip(kept, found, errors)), key=repr)


def rows_of(got):
    def number(v):
        return v if v is None else int(v)

    return sorted(((r.vec_id, r.code, number(r.error), number(r.label_error), r.codebooks_sha256) for r in got), key=repr)


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert rows_of(QUERIES["op13_vector_codes"](spark, "/root/testdata/sf0.01").collect()) == brute(rows)


@pytest.mark.parametrize("spread", [0.01, 1.0, 1e9, 1e17])
def test_odd_rows_and_ties(spark, spread, monkeypatch):
    monkeypatch.setattr(vc, "LEAF", 2)
    monkeypatch.setattr(vc, "BROADCAST_ROWS", 1)
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(c) for c in np.float32(spread * rng.integers(-3, 4, 7))], int(i % 3)) for i in range(120)]
    rows += [(200, None, 1), (201, [None] * 7, 1), (202, [float("nan")] * 7, 1), (203, [float("inf")], 1), (204, [1.0], None), (205, [], None), (None, [2.0] * 7, None)]
    rows += [(5, rows[5][1], 2), (5, rows[6][1], 2), (206, [-0.001] * 7, 2)]
    frame = spark.createDataFrame([(*r, 1, "c", 2) for r in rows], KINDS).repartition(5)
    assert rows_of(vc.vector_codes(frame, parts=4, entries=16).collect()) == brute(rows, parts=4, entries=16)


def test_few_vectors_and_empty_tables(spark):
    frame = spark.createDataFrame([(3, [1.0, 2.0], 1, 0, "", 0), (1, [0.0, 9.0], None, 0, "", 0)], KINDS)
    assert rows_of(vc.vector_codes(frame).collect()) == brute([(3, [1.0, 2.0], 1), (1, [0.0, 9.0], None)])
    assert vc.vector_codes(frame.where("false")).count() == 0
    with pytest.raises(ValueError):
        vc.vector_codes(frame, entries=257)


def test_search_equals_a_scan_and_prunes():
    rng = np.random.default_rng(6)
    for most in (3, 1000, 1 << 40):
        entries, x = rng.integers(-most, most, (64, 4)), rng.integers(-most, most, (500, 4))
        index, distance = vc.Codebook(entries).nearest(x)
        away = (x.astype(object)[:, None] - entries.astype(object)) ** 2
        away = away.sum(2)
        assert distance.tolist() == away.min(1).tolist()
        assert index.tolist() == [row.tolist().index(min(row)) for row in away]
