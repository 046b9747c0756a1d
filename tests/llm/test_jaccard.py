import numpy as np

import corpus_pipeline
from pairloom.llm.common import forest
from pairloom.llm.jaccard import band_keys, bucket_groups, jaccard_components, jaccard_links, shingle_set, similar


def plain_groups(rows, threshold=0.8):
    def shingles(text):
        words = (text or "").encode().lower().split()
        return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [shingles(t) for _, t in rows]
    least = list(range(len(rows)))

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "").lower().split() == (rows[j][1] or "").lower().split()
            if same or sets[i] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                least[b] = a
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(root(i), set()).add(doc)
    return {min(g) for g in groups.values()}


def test_stage_equals_brute_force_jaccard(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = plain_groups([(r.doc_id, r.text) for r in docs.collect()])
    got = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # 1 and 255 have a similarity of 0.83 and fingerprints 7 bits apart.
    assert 1 in want and 255 not in want


def test_hot_buckets_are_cut_into_blocks(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join([*base, f"x{k}"])) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len({r.component for r in jaccard_components(docs).collect()}) == 1
    made = [(node - (1 << 64) if node >> 63 else node, bytearray(s.tobytes()), band_keys(s).tolist(), len(s)) for (node, _), s in (shingle_set(t.encode()) for _, t in rows)]
    texts = spark.createDataFrame(made, "node long, shingles binary, bands array<long>, size long")
    links = jaccard_links(bucket_groups(texts.select("node", "bands", "size"), block=8), texts.select("node", "shingles"), 0.8).collect()
    node, root = forest(np.array([r.a for r in links]), np.array([r.b for r in links]))
    assert len(node) == 59 and len(set(root.tolist())) == 1


def test_only_rows_of_one_group_are_dropped(spark):
    # One id with two texts, and copies without an id.
    rows = [(1, "one two three four five six"), (2, "seven eight nine ten eleven twelve"), (2, "one two three four five six"), (3, "red green blue grey"), (3, "cyan pink teal"), (None, "alone here"), (None, "alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()))
    assert got == [(0, "alone here"), (1, rows[0][1]), (2, rows[1][1]), (3, "cyan pink teal"), (3, "red green blue grey")]


def test_spanning_links_equal_all_links():
    rng = np.random.default_rng(9)
    for _ in range(30):
        sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64) * np.uint64(1 << 20)) for _ in range(40)]
        sets += [np.unique(np.append(s[rng.random(len(s)) < 0.9], rng.integers(0, 9, 2).astype(np.uint64))) for s in sets]
        i, j = map(np.array, zip(*[(a, b) for a in range(80) for b in range(a) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))]))
        want, got = forest(i, j), forest(*similar(sets, 0.8))
        assert dict(zip(*want)) == dict(zip(*got))


def test_many_long_near_copies(spark, monkeypatch):
    from pairloom.llm import jaccard

    rng = np.random.default_rng(10)
    base = rng.integers(0, 5_000, 20_000).astype(str)
    rows = []
    for k in range(1024):
        own = base.copy()
        own[rng.integers(0, 20_000, 20)] = f"own{k}"
        rows.append((k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    largest = []
    of = jaccard.bucket_groups

    def seen(texts, block=jaccard.BLOCK):
        grouped = of(texts, block)
        largest.append(grouped.distinct().join(texts, "node").groupBy("g").sum("size").agg({"sum(size)": "max"}).first()[0] * 8)
        return grouped

    monkeypatch.setattr(jaccard, "bucket_groups", seen)
    assert len({r.component for r in jaccard_components(docs).collect()}) == 1
    assert largest[0] <= 2.5 * jaccard.BLOCK_BYTES


def test_texts_of_near_fingerprints_are_compared_whatever_their_bands(spark):
    from pairloom.llm.jaccard import with_simhash

    made = [(1, [10], 5, 0), (2, [20], 5, 0b1111), (3, [30], 5, 0b11111111), (4, [40], 5, -1), (5, [50], 5, -1), (6, [60], 5, 0x5555555555)]
    texts = spark.createDataFrame(made, "node long, bands array<long>, size long, fp long")
    groups = {}
    for r in bucket_groups(with_simhash(texts)).collect():
        groups.setdefault(r.g, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3], [4, 5]]
