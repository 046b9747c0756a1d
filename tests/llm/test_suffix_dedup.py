import hashlib

import numpy as np
import pytest

from pairloom.llm import suffix_dedup as sd

KINDS = "doc_id long, text string, tie string, key int, start int"


def brute(rows, length=100):
    """Sorted (doc_id, n_bytes, n_removed, n_spans, sha256) of (doc_id, text) rows; rows of one id must have one text."""
    data = [(i, (t or "").encode()) for i, t in rows]
    first: dict[bytes, tuple] = {}
    order = sorted(range(len(data)), key=lambda n: (data[n][0] is None, data[n][0] or 0, n))
    out = []
    for rank, n in enumerate(order):
        text = data[n][1]
        gone = np.zeros(len(text) + 1, bool)
        for at in range(len(text) - length + 1):
            if first.setdefault(text[at: at + length], (rank, at)) != (rank, at):
                gone[at: at + length] = True
        kept = bytes(np.frombuffer(text, np.uint8)[~gone[:-1]])
        spans = int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1))
        out.append((data[n][0], len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, length=100):
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], KINDS).repartition(5)
    return sorted([tuple(r) for r in sd.repeat_digests(frame, length).collect()], key=repr)


def texts(rng, n):
    """Texts of shared passages, copies with edits, runs of one letter and of short periods."""
    words = ["".join(rng.choice(list("abcdefé"), rng.integers(1, 9))) for _ in range(300)]
    passage = [" ".join(rng.choice(words, rng.integers(15, 80))) for _ in range(6)]
    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.integers(1, 5)):
            kind = rng.integers(0, 6)
            if kind == 0:
                parts.append("ab"[: rng.integers(1, 3)] * int(rng.integers(1, 200)))
            elif kind < 3:
                p = passage[rng.integers(0, 6)]
                at = int(rng.integers(0, 60))
                parts.append(p[at: len(p) - int(rng.integers(0, 60))])
            elif kind == 3 and out:
                p = list(out[rng.integers(0, len(out))])
                if p:
                    p[rng.integers(0, len(p))] = "Z"
                parts.append("".join(p))
            else:
                parts.append(" ".join(rng.choice(words, rng.integers(1, 60))))
        out.append("".join(parts))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, monkeypatch):
    rng = np.random.default_rng(seed)
    if seed == 2:
        # Small buckets and pieces, so equal windows lie in several buckets and blocks are cut.
        monkeypatch.setattr(sd, "BUCKET_ROWS", 20)
        monkeypatch.setattr(sd, "ANCHOR_ROWS", 3)
        monkeypatch.setattr(sd, "SMALL", 4)
        monkeypatch.setattr(sd, "PIECE", 256)
    rows = [(int(i), t) for i, t in enumerate(texts(rng, 150))]
    rows += [(-5, rows[3][1]), (1000, rows[4][1]), (1001, None), (1002, ""), (1003, "x" * 99), (1004, "y" * 100), (1005, "y" * 101)]
    rows += [(None, rows[7][1] + "tail of its own")]
    assert run(spark, rows) == brute(rows)


def test_another_length(spark):
    rows = [(int(i), t) for i, t in enumerate(texts(np.random.default_rng(3), 60))]
    assert run(spark, rows, 41) == brute(rows, 41)


def test_repeated_rows_and_empty_tables(spark):
    text = "".join(np.random.default_rng(4).choice(list("abc "), 500))
    rows = [(1, text), (1, text), (1, text), (None, text), (2, "short"), (2, "short"), (None, None), (None, None)]
    got = run(spark, rows)
    whole, none = hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(b"").hexdigest()
    short = (2, 5, 0, 0, hashlib.sha256(b"short").hexdigest())
    empty = (None, 0, 0, 0, none)
    assert got == sorted([(1, 500, 0, 0, whole), (1, 500, 500, 1, none), (1, 500, 500, 1, none), (None, 500, 500, 1, none), short, short, empty, empty], key=repr)
    assert sd.repeat_digests(spark.createDataFrame([], KINDS)).count() == 0


def test_an_id_of_two_texts(spark):
    """Either order of an id's texts may be taken; one of them stays whole."""
    a, b = ("".join(np.random.default_rng(s).choice(list("abc "), 300)) for s in (5, 6))
    got = {r[1]: r[2] for r in run(spark, [(7, a + b), (7, a)])}
    assert got in ({600: 0, 300: 300}, {600: 300, 300: 0})


def test_very_long_texts(spark):
    rng = np.random.default_rng(7)
    long = "".join(rng.choice(list("abcdefgh "), 3_000_000))
    rows = [(1, long), (2, "q" * 2_000_000), (3, long[:1_500_000] + "!" + long[1_500_000:]), (4, " " * 1_000_000)]
    got = {r[0]: r[1:4] for r in run(spark, rows)}
    assert got[1] == (3_000_000, 0, 0)
    assert got[2] == (2_000_000, 1_999_999, 1) and got[4] == (1_000_000, 999_999, 1)
    assert got[3] == (3_000_001, 3_000_000, 2)


def test_multikey_quicksort_orders_bytes():
    rng = np.random.default_rng(8)
    values = [bytes(rng.integers(0, 3, rng.integers(0, 12)).astype(np.uint8)) for _ in range(5000)]
    order, shared = sd.sorted_strings(values, 16)
    rows = [values[i].ljust(16, b"\0") for i in order]
    assert rows == sorted(x.ljust(16, b"\0") for x in values)
    for n in range(1, 200):
        same = [x == y for x, y in zip(rows[n - 1], rows[n])]
        assert shared[n] == (16 if all(same) else same.index(False))
