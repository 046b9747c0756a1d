import numpy as np
import xxhash

from pairloom.llm.common import forest
from pairloom.llm.simhash import covering_masks, near_links, simhash_components, text_fingerprint


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        words = words.replace(space, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, radius=4):
    least = {i: i for i, _ in rows}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    prints = {i: plain_fingerprint(t) for i, t in rows}
    ids = sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                least[b] = a
    return {i: (f"{prints[i]:016x}", root(i)) for i in ids}


def test_masks_cover_every_pair_within_the_radius():
    masks = [m % (1 << 64) for m in covering_masks(4)]
    rng = np.random.default_rng(1)
    for k in range(5):
        for _ in range(500):
            diff = sum(1 << int(b) for b in rng.choice(64, k, replace=False))
            assert any(m & diff == 0 for m in masks)


def test_equals_brute_force_on_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_components(docs).collect()}
    assert got == plain_components(rows)


def test_nulls_short_texts_repeats_and_extra_columns(spark):
    words = "one two three four five six seven eight nine ten"
    rows = [(5, None), (3, ""), (9, " \t\n"), (4, "One  two"), (7, "one two"), (8, words), (8, words), (2, words + " x"), (1, "é ß z")]
    docs = spark.createDataFrame([(i, t, 0, "k") for i, t in rows], "doc_id long, text string, fp int, component string")
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash_components(docs).collect()]
    want = plain_components(rows)
    assert sorted(got) == sorted((i, *want[i]) for i, _ in rows)
    empty = docs.where("false")
    assert simhash_components(empty).count() == 0


def test_blocks_of_a_hot_bucket_lose_no_link():
    rng = np.random.default_rng(3)
    base = int(rng.integers(1 << 62))
    for count in (400, 2048):
        values = np.unique(np.array([base ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in range(count)], np.uint64).view(np.int64))
        node, root = near_links(values, 4)
        plain = values.view(np.uint64)
        i, j = np.where(np.bitwise_count(plain[:, None] ^ plain[None]) <= 4)
        want = forest(values[i], values[j])
        assert dict(zip(node, root)) == dict(zip(*want))


def test_the_sign_bit_counts_as_one(spark):
    from pairloom.llm.simhash import fingerprint_links

    values = [1, -(1 << 63), -(1 << 63) + 6, -1, (1 << 63) - 1, 0x0F0F0F0F]
    links = fingerprint_links(spark.createDataFrame([(v,) for v in values], "fp long"), 4).collect()
    node, root = forest(np.array([r.a for r in links]), np.array([r.b for r in links]))
    same = {n: int(r) for n, r in zip(node.tolist(), root.tolist())}
    assert len({same.get(v, v) for v in values}) == 3
    assert len({same.get(v, v) for v in values[:3]}) == len({same.get(v, v) for v in values[3:5]}) == 1


def test_hot_groups_are_cut_into_blocks(spark):
    from pairloom.llm.components import connected_components
    from pairloom.llm.simhash import fingerprint_links

    rng = np.random.default_rng(4)
    base = int(rng.integers(1 << 62))
    values = sorted({base ^ sum(1 << int(b) for b in rng.choice(64, 2, replace=False)) for _ in range(300)})
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    parts = connected_components(fingerprint_links(frame, 4, block=16)).collect()
    assert len({r.component for r in parts}) == 1 and len(parts) == len(values)


def test_no_table_of_buckets_is_broadcast(spark):
    from pairloom.llm.common import stored
    from pairloom.llm.simhash import fingerprint_links

    # Two near ones of each: a table of few bytes, whose buckets are many times as many.
    values = stored(spark.range(20_000).selectExpr("explode(array(xxhash64(id), xxhash64(id) ^ 1)) as fp"), "values")
    links = fingerprint_links(values, 4)
    links.write.format("noop").mode("overwrite").save()
    assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()
    assert links.count() >= 20_000


def test_one_text():
    assert text_fingerprint(b"A b c d E") == plain_fingerprint("A b c d E")
