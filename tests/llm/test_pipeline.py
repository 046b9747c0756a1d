from collections import defaultdict

import corpus_pipeline
from pairloom.llm.secret_scan import base_spans
from tests.llm.test_jaccard import plain_groups
from tests.llm.test_packing import check


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    seen = {}
    frame = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, "/root/testdata/sf0.001").cache()
        assert frame.columns == columns
        seen[name] = {r.doc_id: r for r in frame.collect()}
    accepted = seen["language_id"]
    assert len(accepted) >= 0.98 * len(rows) and all(accepted[i] == rows[i] for i in accepted)
    assert set(seen["near_dedup"]) == plain_groups([(i, r.text) for i, r in accepted.items()])
    assert all(seen["near_dedup"][i] == rows[i] for i in seen["near_dedup"])
    clean = seen["secret_scan"]
    assert set(clean) == set(seen["near_dedup"])
    for i, r in clean.items():
        assert r.n_chars == len(r.text)
        if base_spans(rows[i].text):
            assert not base_spans(r.text) and r.text != rows[i].text
    packed = corpus_pipeline.STAGES[-1][1](spark, frame, "").collect()
    check(packed, [(i, r.text) for i, r in clean.items()], 2048)


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "the cat and the dog", "en", "s", 19), (3, "the cat and the dog", "en", "s", 19), (4, "1234 56", "en", "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.where("false")):
        frame = table
        for _, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, "").cache()
        ids = defaultdict(int)
        for r in frame.collect():
            ids[r.doc_id] += 1
        assert dict(ids) in ({3: 1}, {})


def test_long_blanks_and_clashing_columns(spark):
    words = "the quick brown fox jumps over the lazy dog and runs away from it "
    texts = [words * 3, words * 3, words + " " * 3_000_000 + words, words + "\n" * 3_000_000, " " * 3_000_000]
    rows = [(i, t, "en", "s", len(t), i, 2 * i, str(i), str(i), i, i) for i, t in enumerate(texts)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, row long, node int, lang_pred string, `a.b` string, own int, others int"
    frame = docs = spark.createDataFrame(rows, kinds)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, "").cache()
        assert frame.schema == docs.schema
    kept = {r.doc_id: r for r in frame.collect()}
    assert all(r.row == i and r.node == 2 * i and r.lang_pred == str(i) and r["a.b"] == str(i) and r.own == r.others == i for i, r in kept.items())
    # The first three have the same shingles; the last has no language.
    assert set(kept) == {0, 3}
    packed = corpus_pipeline.STAGES[-1][1](spark, frame, "").collect()
    check(packed, [(i, r.text) for i, r in kept.items()], 2048)
