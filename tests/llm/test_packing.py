import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pairloom.llm.packing import TextEncoder, best_fit, crossed, evolve, first_population, pack_documents, pack_pieces

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN = TextEncoder(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=6), st.sampled_from([" ", "\n", "  ", "\t", "'s", "<|endoftext|>", "\x1c", "\x85", "a1", "é"])), max_size=12))
def test_ids_equal_the_librarys(parts):
    text = "".join(parts)
    assert np.frombuffer(OWN.ids(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_evolution_keeps_every_item_and_no_bin_overflows():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 101, 400).tolist()
    people = first_population(sizes, 100, rng, 4)
    child = crossed(people[0], people[3], sizes, 100, rng)
    for bins in (child, *evolve(sizes, people, 100, 20, rng)):
        assert sorted(i for b in bins for i in b) == list(range(400))
        assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
    assert len(evolve(sizes, people, 100, 20, rng)[0]) <= len(people[0])


def test_evolution_needs_fewer_bins_than_best_fit_where_sizes_are_hard():
    saved = 0
    for seed in range(6):
        rng = np.random.default_rng(seed)
        sizes = []
        for _ in range(40):
            # Three sizes that fill a bin exactly; best fit in falling order pairs the large ones.
            a = int(rng.integers(380, 490))
            b = int(rng.integers((1000 - a) // 2 - 60, (1000 - a) // 2))
            sizes += [a, b, 1000 - a - b]
        rng.shuffle(sizes)
        people = first_population(sizes, 1000, rng, 4)
        evolved = evolve(sizes, people, 1000, 300, rng)[0]
        assert 40 <= len(evolved) <= min(map(len, people))
        saved += len(people[0]) - len(evolved)
    assert saved >= 4, saved


def test_best_fit_takes_the_tightest_bin():
    bins = [[0], [1]]
    best_fit([2], [50, 70, 30], bins, 100)
    assert bins == [[0], [1, 2]]


def check(rows, texts, capacity):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    want = defaultdict(list)
    for i, text in texts:
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids), capacity), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i].append((k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert {i: sorted((r.piece, r.start, r.length, r.ids_crc32) for r in p) for i, p in pieces.items()} == {i: sorted(x) for i, x in want.items()}
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    total = sum(r.length for r in rows)
    return len(sequences), -(-total // capacity)


def test_query_on_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pack_documents(docs, PATH).collect()
    used, least = check(rows, [(r.doc_id, r.text) for r in docs.collect()], 2048)
    assert used <= least * 1.02 + 1, (used, least)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, pack_documents(docs, PATH).collect()))


def test_nulls_repeats_and_long_texts(spark):
    texts = [(1, None), (1, None), (2, ""), (3, "word " * 5000), (None, "a"), (4, "<|endoftext|> x")]
    docs = spark.createDataFrame([(*r, 0, 1) for r in texts], "doc_id long, text string, length int, shard int")
    rows = pack_documents(docs, PATH, capacity=64).collect()
    check(rows, texts, 64)
    assert pack_documents(docs.where("false"), PATH).count() == 0


def test_long_runs_of_white_space(spark):
    texts = {1: " " * 3_000_000, 2: "\n" * 3_000_000, 3: "a" + " \n" * 1_500_000 + "b"}
    for text in (*texts.values(), "\t" * 9_999 + "x", "y" + " " * 10_000 + "x"):
        assert np.frombuffer(OWN.ids(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(pack_documents(docs, PATH, capacity=2048).collect(), list(texts.items()), 2048)


def test_the_default_search_needs_fewer_sequences_than_best_fit_where_sizes_are_hard(spark):
    rng = np.random.default_rng(5)
    sizes = []
    for _ in range(40):
        a = int(rng.integers(780, 1000))
        b = int(rng.integers((2048 - a) // 2 - 120, (2048 - a) // 2))
        sizes += [a, b, 2048 - a - b]
    pieces = spark.createDataFrame([(i, 0, n) for i, n in enumerate(sizes)], "doc_id long, piece int, length long").coalesce(1)
    used = pack_pieces(pieces, 2048).select("sequence_id").distinct().count()
    short = pack_pieces(pieces, 2048, islands=2, epochs=2, generations=6, population=3).select("sequence_id").distinct().count()
    assert 40 <= used < short, (used, short)
