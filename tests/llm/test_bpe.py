import hashlib
import time

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pairloom.llm.bpe import RankArrayBPE, bpe_decode, bpe_digests, bpe_encode

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN = RankArrayBPE(PATH)

CASES = [
    "", " ", "Hello, World's  best 123 x's we'll", "<|endoftext|>a <|startoftext|><|endoftext|> b", "ΣΑΣ Ό Ά ός İstanbul ß ŉ",
    "éa ́x", "a\x1cb\x1dc\x85d\xa0e　f​g", "日本語テキスト😀😀‼️", "½ Ⅷ ٣ 12345", "'S 'RE don'T", "퟿", "a" * 300, "<|endoftext", "\x00\x01\x7f",
]


@pytest.mark.parametrize("text", CASES)
def test_equals_the_library(text):
    want = LIBRARY.encode(text, add_special_tokens=False)
    assert OWN.encode(text) == want.ids
    assert OWN.decode(want.ids) == LIBRARY.decode(want.ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_equals_the_library_on_any_text(text):
    assert OWN.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def library_rows(rows):
    out = []
    for i, text in rows:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        digests = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), decoded.encode())]
        out.append((i, len(ids), *digests))
    return out


def test_query_equals_the_library_on_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = library_rows([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(tuple, bpe_digests(docs, PATH).collect())) == sorted(want)


def test_nulls_empties_repeats_and_extra_columns(spark):
    rows = [(1, None), (1, None), (None, "a b"), (3, ""), (4, "Long " * 50_000), *enumerate(CASES, 10)]
    docs = spark.createDataFrame([(*r, 5, "z") for r in rows], "doc_id long, text string, n_tokens int, ids string")
    key = lambda r: (r[0] or 0, *r[1:])
    assert sorted((tuple(r) for r in bpe_digests(docs, PATH).collect()), key=key) == sorted(library_rows(rows), key=key)
    assert bpe_digests(docs.where("false"), PATH).count() == 0
    back = {r.doc_id: r.text for r in bpe_decode(bpe_encode(docs, PATH), PATH).collect()}
    assert back[12] == LIBRARY.decode(LIBRARY.encode(CASES[2], add_special_tokens=False).ids, skip_special_tokens=False)


def test_one_very_long_word_equals_the_library():
    rng = np.random.default_rng(2)
    word = "".join(rng.choice(list("etaoinshr"), 1_000_000).tolist())
    began = time.perf_counter()
    got = OWN.encode(word)
    assert time.perf_counter() - began < 60
    assert got == LIBRARY.encode(word, add_special_tokens=False).ids
    for size in (255, 256, 257, 258, 5000):
        for text in (word[:size], "a" * size, "日本" * size):
            assert OWN.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids
    OWN.encode("short")
    assert max(map(len, [*OWN.chunks, *OWN.words])) <= 258
