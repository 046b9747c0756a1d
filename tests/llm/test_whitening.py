import numpy as np
import pytest

from pairloom.llm.queries import QUERIES
from pairloom.llm.whitening import Scatter, digits_needed, fit_whitening, limbs, whiten

KINDS = "vec_id long, embedding array<float>, component int, n long, x int"


def fine(v):
    return v is not None and all(c is not None and np.isfinite(c) for c in v)


def brute(rows, scale=256):
    """{place: (x, deviation)}, n, S and the covariance over distinct x of (vec_id, vector) rows, in Python's integers."""
    size = max((len(v) for _, v in rows if fine(v)), default=0)

    def cut(v):
        return min(max(v, -(1 << 63)), (1 << 63) - 1)

    xs = {n: tuple(cut(int(np.floor(scale * np.float64(np.float32(c))))) for c in v) + (0,) * (size - len(v)) for n, (_, v) in enumerate(rows) if fine(v)}
    fit = sorted(set(xs.values()))
    n, total = len(fit), [sum(c) for c in zip(*fit)]
    scatter = [[n * sum(x[i] * x[j] for x in fit) - total[i] * total[j] for j in range(size)] for i in range(size)]
    deviation = {k: sum((n * a - s) ** 2 for a, s in zip(x, total)) for k, x in xs.items()}
    return xs, deviation, n, total, np.array([[c / (n * n) for c in row] for row in scatter])


def check(rows, got, components=4):
    xs, deviation, n, total, covariance = brute(rows)
    values, directions = np.linalg.eigh(covariance)
    values, directions = values[::-1], directions[:, ::-1]
    count = min(components, int((values > len(values) * 2.3e-16 * values[0]).sum()))
    byrow = {}
    for r in got:
        byrow.setdefault(r.vec_id, []).append(r)
    assert len(got) == count * len(xs)
    signs = [0] * count
    for place, x in xs.items():
        own = sorted(byrow[rows[place][0]], key=lambda r: r.component)
        assert [r.component for r in own] == list(range(1, count + 1))
        centred = np.array([float((n * a - s)) / n for a, s in zip(x, total)])
        for k, r in enumerate(own):
            assert r.n == n and int(r.deviation) == deviation[place]
            assert abs(r.explained - values[k] / values.sum()) <= 1e-9 * r.explained + 1e-15
            assert r.identity_error == own[0].identity_error <= 1e-6
            want = centred @ directions[:, k] / np.sqrt(values[k])
            # One sign for all rows; tiny projections say nothing about it.
            if abs(want) > 1e-3:
                signs[k] = signs[k] or np.sign(want * r.whitened)
            assert abs(r.whitened - (signs[k] or 1) * want) <= 1e-6 * max(1, abs(want))


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(rows, QUERIES["op11_whitening"](spark, "/root/testdata/sf0.01").collect())


@pytest.mark.parametrize("shift, spread", [(0, 1), (1e6, 3), (-3e9, 1e7), (0, 1e12)])
def test_odd_rows_and_large_numbers(spark, shift, spread):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(c)) for c in shift + spread * rng.normal(size=5) * [5, 4, 3, 2, 1]]) for i in range(200)]
    rows += [(300 + i, rows[i % 3][1]) for i in range(40)]
    rows += [(400, None), (401, [None, 1.0]), (402, [float("nan")] * 5), (403, [float("inf")] * 5), (404, [shift + 1.0]), (405, []), (406, [-0.0] * 5)]
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], KINDS).repartition(6)
    check(rows, whiten(frame, fit_whitening(frame)).collect())


def test_saturated_components(spark):
    rows = [(0, [3e38, 1.0]), (1, [-3e38, 2.0]), (2, [0.0, -5.0]), (3, [1.0, 4.0])]
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], KINDS)
    got = whiten(frame, fit_whitening(frame)).collect()
    xs, deviation, n, _, _ = brute(rows)
    assert {r.vec_id: r.n for r in got} == {i: n for i in range(4)}
    assert all(r.deviation is None or int(r.deviation) == deviation[r.vec_id] for r in got)


def test_no_variance_no_vectors_and_repeated_rows(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0], 0, 0, 0), (1, [1.0, 2.0], 0, 0, 0), (None, [1.0, 2.0], 0, 0, 0)], KINDS)
    assert whiten(one, fit_whitening(one)).count() == 0
    none = one.where("false")
    assert whiten(none, fit_whitening(none)).count() == 0
    two = one.union(spark.createDataFrame([(2, [3.0, 2.0], 0, 0, 0)], KINDS))
    got = whiten(two, fit_whitening(two)).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component, r.n) for r in got) == [(False, 1, 1, 2), (False, 1, 1, 2), (False, 2, 1, 2), (True, 0, 1, 2)]
    assert {round(abs(r.whitened), 12) for r in got} == {1.0}


def test_scatter_and_limbs_are_exact():
    rng = np.random.default_rng(5)
    for most in (5, 1 << 19, 1 << 21, 1 << 45, 1 << 62):
        x = rng.integers(-most, most, size=(4500, 3))
        shift = rng.integers(-most, most, size=3)
        own = Scatter(shift)
        own.add(x)
        y = [[int(a) - int(s) for a, s in zip(row, shift)] for row in x]
        want = [len(y), *[sum(c) for c in zip(*y)], *[sum(r[i] * r[j] for r in y) for i in range(3) for j in range(i, 3)]]
        assert own.numbers() == want
        assert all(sum(v << (32 * k) for k, v in enumerate(limbs(number))) == number for number in want)
    assert digits_needed(np.array([[1 << 20]])) == 2 and digits_needed(np.array([[-(1 << 20)]])) == 1
