import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairloom.llm import token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.encode_special_tokens = True
COUNTER = tc.PretokenCounter(PATH)


def whole(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


PARTS = st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "'", "re", "s", "ll", "12", "é", ".", "!?", "\t", "x" * 9, " of", "日本"]), max_size=60).map("".join)


@settings(max_examples=200, deadline=None)
@given(PARTS, st.lists(st.tuples(st.integers(0, 200), st.integers(0, 30), PARTS.map(lambda x: x[:20])), max_size=5), st.sampled_from([1, 2, 64]))
def test_edits_equal_a_new_count(text, edits, leaf):
    old, tc.LEAF = tc.LEAF, leaf
    try:
        counted = tc.CountedText(text, COUNTER)
        assert counted.tokens == whole(text)
        for at, gone, new in edits:
            counted.edit(at, at + gone, new)
            text = text[:at] + new + text[at + gone :]
            assert counted.text == text
            assert counted.tokens == whole(text)
            assert counted.chars == len(text)
            counted = tc.CountedText(text, COUNTER, counted.kept())
            assert counted.tokens == whole(text)
    finally:
        tc.LEAF = old


def test_only_the_edited_region_is_encoded():
    text = "the cat sat on a mat, and it's 12 years old.\n" * 2000
    counted = tc.CountedText(text, COUNTER)
    counted.edit(45_000, 45_010, "brand new words")
    assert counted.tokens == whole(counted.text)
    assert counted.encoded < 2000


def test_query_equals_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = tc.edit_token_counts(docs, tc.sample_edits(F.col("text")), PATH).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id]
        assert r.n_tokens == whole(text)
        n = len(text)
        for at, gone, new in ((3 * n // 4, 0, text[:40]), (n // 2, 25, ""), (n // 4, 10, " edited's " + text[-10:])):
            text = text[:at] + new + text[at + gone :]
        assert (r.edited_tokens, r.edited_chars) == (whole(text), len(text))


def test_nulls_empties_repeats(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "<|endoftext|>"), (4, "long  words " * 30_000)]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, n_tokens int")
    got = tc.edit_token_counts(docs, F.lit(None).cast("array<struct<at:int,gone:int,new:string>>"), PATH).collect()
    key = lambda r: (r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.n_tokens, r.edited_tokens) for r in got), key=key) == sorted(((i, whole(t or ""), whole(t or "")) for i, t in rows), key=key)
    assert tc.edit_token_counts(docs, tc.sample_edits(F.col("text")), PATH).count() == len(rows)
    assert tc.edit_token_counts(docs.where("false"), tc.sample_edits(F.col("text")), PATH).count() == 0


def test_an_edit_makes_few_nodes():
    text = "the cat sat on a mat, and it's 12 years old.\n" * 20_000
    counted = tc.CountedText(text, COUNTER)
    leaves = counted.tree.leaves
    assert leaves > 3000
    for n in range(300):
        made, at = tc.Node.made, (n * 7919) % len(counted.text)
        counted.edit(at, at + (60 if n % 3 == 0 else 0), "" if n % 3 == 0 else " one two three four five six seven")
        assert tc.Node.made - made <= 8 * 12
    assert counted.tokens == whole(counted.text)
    sizes = [len(a) for a, _ in tc.leaves_from(counted.tree, 0)]
    assert max(sizes) <= 2 * tc.LEAF and counted.tree.height <= 1.5 * np.log2(len(sizes)) + 2


def test_kept_trees_are_edited_again(spark):
    rows = [(1, "a b c " * 500, None), (2, None, None), (2, "", None), (None, "it's " * 2000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tree binary")
    none = F.lit(None).cast("array<struct<at:int,gone:int,new:string>>")
    made = tc.edit_kept_trees(docs, none, PATH)
    once = tc.edit_kept_trees(made.drop("n_tokens"), tc.sample_edits(F.col("text")), PATH)
    twice = tc.edit_kept_trees(once, tc.sample_edits(F.col("text")), PATH).collect()
    assert len(twice) == 4
    for r in twice:
        assert r.edited_tokens == whole(r.text) and r.edited_chars == len(r.text) and r.encoded_chars <= max(len(r.text), 3000)
    again = {(r.doc_id, r.text): r.n_tokens for r in once.collect()}
    assert all(n >= 0 for n in again.values())


def test_one_very_long_word(spark):
    text = "x" * 1_000_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = tc.edit_token_counts(docs, tc.sample_edits(F.col("text")), PATH).first()
    assert got.n_tokens == whole(text)


def test_long_runs_of_white_space(spark):
    texts = {1: " " * 3_000_000, 2: "\n" * 3_000_000, 3: "a" + " \n" * 1_500_000 + "b", 4: "\u3000" * 500_000 + "x"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    edits = F.array(F.struct(F.lit(1_000).alias("at"), F.lit(3).alias("gone"), F.lit(" mid ").alias("new")))
    for r in tc.edit_token_counts(docs, edits, PATH).collect():
        text = texts[r.doc_id]
        assert (r.n_tokens, r.edited_tokens) == (whole(text), whole(text[:1_000] + " mid " + text[1_003:]))
