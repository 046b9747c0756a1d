import math
import zlib
from collections import Counter

import numpy as np
import pytest

from pairloom.llm.language_model import NAMED, Spelling, addressed, by_place, draws, language_model_scores, merged_words, numbered, packed, perplexity, places_in, resample_spelling, seat, spelled, stirling_logs, stored, unpacked


def plain_base(rows):
    tokens = lambda t: ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")] + [None]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = c.total(), len(c)
    out = []
    for i, t in rows:
        own = tokens(t)
        out.append((i, held(i), len(own), sum(c[w] > 0 for w in own), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)))
    return out


def compare(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0)
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)


def test_base_equals_brute_force_and_the_model_beats_it(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = language_model_scores(docs).collect()
    compare(got, plain_base(rows))
    held = [r for r in got if r.held_out]
    base, score, tokens = (sum(r[k] for r in held) for k in ("base_score", "score", "n_tokens"))
    assert score > base, (score / tokens, base / tokens)
    assert all(r.score < 0 for r in got)
    shown = {r.held_out: r for r in perplexity(spark.createDataFrame(got)).collect()}
    assert shown[True].perplexity == pytest.approx(10 ** (-score / tokens)) and shown[True].perplexity < shown[True].base_perplexity
    # Words in another order have the same base score and another score.
    assert len({round(r.score - r.base_score, 6) for r in got}) > len(got) / 2


def test_nulls_empties_repeats(spark):
    rows = [(1, None), (2, ""), (3, "A a Ä b"), (3, "A a Ä b"), (None, "zz a"), (5, "long " * 100_000), (6, "y" * 50_000), (None, "z" * 50_000), *((i, f"w{i % 3} x") for i in range(10, 40))]
    docs = spark.createDataFrame([(*r, 1, "w") for r in rows], "doc_id long, text string, n int, word string")
    got = language_model_scores(docs).collect()
    compare(got, plain_base(rows))
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert language_model_scores(docs.where("false")).count() == 0
    alone = language_model_scores(docs.where("doc_id is null")).collect()
    assert alone[0].train_tokens == 0 and alone[0].score == alone[0].base_score == 0


def test_tables_follow_the_conditional():
    d, new, grow = 0.4, 0.7, 0.2
    names = np.arange(40_000)
    got = np.bincount(seat(np.full(40_000, 4), np.full(40_000, new), np.full(40_000, grow), d, stirling_logs(d), names, 1), minlength=5)[1:] / 40_000
    s = stirling_logs(d, 300)
    w = np.exp(s[4, 1:5]) * np.array([math.prod(new + grow * i for i in range(t)) for t in range(1, 5)])
    assert got == pytest.approx(w / w.sum(), abs=0.01)
    # Beyond the table the law stays that of the exact numbers.
    for d, new, grow in ((0.4, 0.7, 0.02), (0.8, 5.0, 0.05), (0.6, 0.05, 0.001), (0.5, 40.0, 0.1), (0.9, 300.0, 0.3)):
        logs = stirling_logs(d, 2000)[2000, 1:2001] + np.cumsum(np.log(new + grow * np.arange(2000)))
        w = np.exp(logs - logs.max())
        w, t = w / w.sum(), np.arange(1, 2001)
        mean = w @ t
        spread = np.sqrt(w @ (t - mean) ** 2)
        got = seat(np.full(4000, 2000), np.full(4000, new), np.full(4000, grow), d, stirling_logs(d), names[:4000], 2)
        print(f"d {d} new {new}: exact mean {mean:.2f} spread {spread:.2f}, drawn {got.mean():.2f} {got.std():.2f}")
        assert abs(got.mean() - mean) < 0.08 * spread + 0.02 * mean and abs(got.std() - spread) < 0.1 * spread + 0.02


def test_draws_depend_on_names_only():
    c, new = np.array([3, 70, 5000, 2]), np.array([0.5, 2.0, 9.0, 0.1])
    names = np.array([11, 12, 13, 14])
    got = seat(c, new, new * 0.1, 0.5, stirling_logs(0.5), names, 3)
    back = seat(c[::-1], new[::-1], new[::-1] * 0.1, 0.5, stirling_logs(0.5), np.ascontiguousarray(names[::-1]), 3)
    assert got.tolist() == back[::-1].tolist()
    u = draws(np.arange(100_000), 5, 1)
    assert u.mean() == pytest.approx(0.5, abs=0.01) and u.var() == pytest.approx(1 / 12, abs=0.01)


def test_scores_do_not_depend_on_how_rows_are_dealt(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = {r.doc_id: r.score for r in language_model_scores(docs.coalesce(1)).collect()}
    many = {r.doc_id: r.score for r in language_model_scores(docs.repartition(7, "doc_id")).collect()}
    assert one.keys() == many.keys() and all(many[i] == pytest.approx(one[i], rel=1e-5) for i in one)


def test_the_model_is_near_a_plain_sampler(spark):
    """A corpus of ten words against a customer-by-customer sampler of the two levels of words."""
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(10)]
    ids = [i for i in range(1, 400) if zlib.crc32(str(i).encode()) % 10]
    texts = [" ".join(rng.choice(vocabulary, 4, p=[0.3, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05, 0.04, 0.03, 0.03]).tolist()) for _ in ids[:60]]
    rows = list(zip(ids, texts))
    got = {r.doc_id: r.score for r in language_model_scores(spark.createDataFrame(rows, "doc_id long, text string"), burn_in=10, samples=10).collect()}
    want = plain_sampler(rows)
    error = np.array([got[i] - want[i] for i in got]) / 5
    print(f"log10 of a token: mean difference {error.mean():.4f}, largest {np.abs(error).max():.4f}")
    assert abs(error.mean()) < 0.02 and np.abs(error).max() < 0.05


def plain_sampler(rows, sweeps=300, burn=100):
    """Text's log10 probabilities by Gibbs sampling of single customers; the base of words is their shape's own: a constant for each."""
    rng = np.random.default_rng(1)
    pairs = [(a, b) for _, t in rows for a, b in zip([""] + t.split(), t.split() + [""])]
    counts = Counter(pairs)
    twos = [sum(c == k for c in counts.values()) for k in (1, 2)]
    d2 = min(0.95, max(0.05, twos[0] / (twos[0] + 2 * twos[1])))
    heads = Counter(b for _, b in counts)
    # Words have one table in each restaurant at first, by which their own discount is set.
    ones = [sum(c == k for c in heads.values()) for k in (1, 2)]
    d1 = min(0.95, max(0.05, ones[0] / (ones[0] + 2 * ones[1]))) if ones[0] else 0.5
    base = 1 / 40
    low: dict = {}
    high: dict = {}

    def p_low(w):
        c, t = sum(low.get(w, [])), len(low.get(w, []))
        every, tables = sum(map(sum, low.values())), sum(map(len, low.values()))
        return (c - d1 * t + (1 + d1 * tables) * base) / (1 + every)

    def add(restaurant, w, d, tables, p_new):
        own = restaurant.setdefault(w, [])
        weight = np.array([n - d for n in own] + [(1 + d * tables) * p_new])
        k = rng.choice(len(weight), p=weight / weight.sum())
        if k == len(own):
            own.append(1)
            return True
        own[k] += 1
        return False

    def remove(restaurant, w):
        own = restaurant[w]
        k = rng.choice(len(own), p=np.array(own) / sum(own))
        own[k] -= 1
        if not own[k]:
            own.pop(k)
            return True
        return False

    def enter(a, w):
        if add(high.setdefault(a, {}), w, d2, sum(map(len, high[a].values())), p_low(w)):
            add(low, w, d1, sum(map(len, low.values())), base)

    for a, w in pairs:
        enter(a, w)
    means, taken = {}, 0
    for sweep in range(sweeps):
        for a, w in pairs:
            if remove(high[a], w):
                remove(low, w)
            enter(a, w)
        if sweep >= burn and sweep % 5 == 0:
            score = {}
            for a, w in counts:
                tables, every = sum(map(len, high[a].values())), sum(map(sum, high[a].values()))
                own = high[a].get(w, [])
                score[a, w] = (sum(own) - d2 * len(own) + (1 + d2 * tables) * p_low(w)) / (1 + every)
            for k in score:
                means[k] = means.get(k, 0.0) + score[k]
            taken += 1
    return {i: sum(math.log10(means[p] / taken) for p in zip([""] + t.split(), t.split() + [""])) for i, t in rows}


def test_spelling_is_a_distribution():
    codes, begin = spelled([b"ab", b"", b"abc"])
    assert begin.tolist() == [0, 3, 4] and len(codes) == 8
    found, counts = np.unique(codes, return_counts=True)
    model: Spelling = resample_spelling(found, counts, 2)
    one = [bytes([a]) for a in range(256)]
    # Every first byte followed by the end, and the bare end: less than all words together.
    assert 0 < np.exp(model.word_logs([b"", *one])).sum() < 1
    first = np.arange(257)
    start = 257 * 258 + 257
    p = model.back[start] * model.parent[257, first]
    at = np.searchsorted(model.codes, start * 258 + first)
    hit = model.codes[np.minimum(at, len(model.codes) - 1)] == start * 258 + first
    p[hit] += model.own[at[hit]]
    assert p.sum() == pytest.approx(1)


def test_a_word_depends_on_the_word_before_it(spark):
    # a is followed by b and c by d: the same words in either order, none at the start of a sentence.
    rows = [(i, "x a b x c d x") for i in range(1, 400)]
    ids = [i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    rows += [(ids[0], "x a b x c d x"), (ids[1], "x a d x c b x")]
    got = {r.doc_id: r for r in language_model_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[ids[0]].base_score == pytest.approx(got[ids[1]].base_score)
    assert got[ids[0]].score > got[ids[1]].score + 3
    # Next words' probabilities: x goes on with a, c or the end, all others are sure.
    assert got[ids[0]].score == pytest.approx(3 * math.log10(1 / 3), abs=0.1)


def test_words_that_span_batches_are_merged_once(spark):
    rows = [(w.encode(), block, place, 1 + block) for block in range(40) for place, w in enumerate(["", "all", f"only{block}", f"pair{block // 2}"])]
    table = spark.createDataFrame(rows, "word binary, block long, place int, n long").repartition(5)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        words = numbered(stored(merged_words(table), "words"))
        found = words.collect()
        sent = addressed(words.select("at", "id"), NAMED, lambda x: {"id": x.column(1).to_numpy()}).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    expected = {}
    for word, block, place, n in rows:
        expected.setdefault(word, [0, set()])
        expected[word][0] += n
        expected[word][1].add((block, place))
    assert {bytes(r["word"]): [r["n"], {tuple(x) for x in r["at"]}] for r in found} == expected and len(found) == len(expected)
    assert sorted(r["id"] for r in found) == list(range(len(expected)))
    id_of = {bytes(r["word"]): r["id"] for r in found}
    for block in range(40):
        got = by_place([bytes(r["data"]) for r in sent if r["block"] == block], NAMED)
        assert got["id"].tolist() == [id_of[w] for w, b, _, _ in rows if b == block]


def test_records_survive_packing_and_keys_are_found():
    kind = np.dtype([("place", "<u4"), ("q", "<f4"), ("n", "<u8")])
    rng = np.random.default_rng(5)
    for size in (0, 1, 2, 1000):
        rows = np.zeros(size, kind)
        rows["place"], rows["q"], rows["n"] = rng.integers(0, 1 << 32, size), rng.normal(size=size), rng.integers(0, 1 << 60, size)
        assert (unpacked(packed(rows, kind), kind) == rows).all()
        table = np.sort(rng.integers(-50, 50, size))
        keys = rng.integers(-60, 60, 300)
        assert (places_in(table, keys) == np.searchsorted(table, keys)).all()


def test_shuffles_of_stored_tables_are_deleted(spark):
    import time

    alive = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses
    spark._jvm.System.gc()
    time.sleep(2)
    before = alive().size()
    table = stored(spark.range(100).selectExpr("id % 10 as id").groupBy("id").count(), "shuffled")
    assert alive().size() <= before
    assert table.count() == 10 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
