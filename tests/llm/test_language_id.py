import zlib

import numpy as np
import pytest

from pairloom.llm import language_id as li
from pairloom.llm.language_id import LONGEST, fit_language_model, has_letter, identify, language_predictions, subwords, text_buckets


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = language_predictions(docs).collect()
    assert {r.doc_id for r in got} == set(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    right = sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held)
    assert right > 0.97, right
    assert sum(r.rejected for r in held) / len(held) < 0.02
    assert all(0 <= r.score <= 1 for r in got)


def test_subwords_are_all_short_ngrams():
    buckets, owner = subwords(["ab", "x"])
    assert (owner == 0).sum() == sum(4 - k + 1 for k in range(1, LONGEST + 1)) and (owner == 1).sum() == 3 + 2 + 1
    assert sorted(subwords(["ab"])[0]) == sorted(buckets[owner == 0])
    assert text_buckets("ab ab AB")[1].sum() == 3 * (owner == 0).sum()


def test_nulls_unlabelled_and_extra_columns(spark):
    rows = [(i, t, l) for i, (t, l) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 30)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "12 34 ...", "en"), (103, "the and", None), (None, "und die", None), (103, "the and", None), (104, "the dog " * 60_000, None)]
    docs = spark.createDataFrame([(*r, "s", 1.0) for r in rows], "doc_id long, text string, lang string, source string, score double")
    got = {(r.doc_id, r.lang_pred) for r in language_predictions(docs).collect()}
    assert {(100, "und"), (101, "und"), (102, "und"), (103, "en"), (None, "de"), (104, "en")} <= got
    model = fit_language_model(docs)
    shown = identify(docs, model)
    assert shown.columns[:5] == docs.columns and shown.count() == len(rows)
    blank = docs.withColumn("lang", docs["lang"].substr(100, 1)).where("false")
    assert language_predictions(blank).count() == 0
    nothing = identify(docs, fit_language_model(blank)).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in nothing] == ["und"]


def test_numerals_are_no_letters(spark):
    assert not any(map(has_letter, ("½", "²", "Ⅷ", "①", "12 3.", "_-", ""))) and all(map(has_letter, ("ß", "é", "日", "1a")))
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("½ ² Ⅷ", "en")] * 30)]
    rows += [(100, "½", None), (101, "² Ⅷ ①", None)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_predictions(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[100] == got[101] == got[2] == ("und", 0.0)


def test_predictions_equal_plain_averages_of_ngram_vectors(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = fit_language_model(docs)
    for r in identify(docs, model).collect():
        total, n = np.zeros(model.embedding.shape[1]), 0
        for word in (r.text or "").lower().split():
            for bucket in subwords([word])[0]:
                total, n = total + model.embedding[bucket], n + 1
        if not has_letter(r.text or ""):
            assert r.lang_pred == "und"
            continue
        z = total / n @ model.weight / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert r.lang_score == pytest.approx(p.max()) and r.lang_pred == model.languages[int(p.argmax())]
        assert r.lang_rejected == (r.lang_score < model.reject_below)


def test_a_language_left_out_is_rejected_more_often(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null")
    left_out = sorted(r.lang for r in docs.select("lang").distinct().collect())[0]
    shown = identify(docs, fit_language_model(docs.where(docs["lang"] != left_out)))
    rejected = {r.own: r.n for r in shown.selectExpr(f"lang = '{left_out}' as own", "cast(lang_rejected as double) as x").groupBy("own").avg("x").withColumnRenamed("avg(x)", "n").collect()}
    assert rejected[False] < 0.005 and rejected[True] > 0.1


def test_ties_and_equal_texts(spark):
    rows = [(i, "la la la", "aa" if i % 2 else "bb") for i in range(40)]
    got = language_predictions(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len({(r.lang_pred, r.score) for r in got}) == 1 and got[0].lang_pred in ("aa", "bb")


def test_sample_is_bounded_in_bytes_and_repeats_count_once(spark):
    rows = [(i, f"the cat w{i} and dogs", "en") for i in range(60)] + [(i, f"der hund w{i} und die katze", "de") for i in range(60, 90)]
    rows += [(None, "same words each time", "en")] * 400 + [(100, "la lune", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []

    def train(found, *args, **kwargs):
        seen.append(found)
        return li.LanguageModel([], np.zeros((1, 1)), np.zeros((1, 0)))

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(li, "train", train)
        fit_language_model(docs)
        everything = [lang for lang, _, _ in seen[-1]]
        assert [everything.count(x) for x in ("de", "en", "fr")] == [30, 61, 1]
        sizes = sum(6 * len(b) for _, b, _ in seen[-1])
        fit_language_model(docs, sample_bytes=sizes // 3)
        few = [lang for lang, _, _ in seen[-1]]
        assert few.count("fr") == 1 and few.count("de") == few.count("en") > 5
        assert sizes // 4 < sum(6 * len(b) for _, b, _ in seen[-1]) <= sizes // 3
        fit_language_model(docs, sample_bytes=1)
        assert sorted(lang for lang, _, _ in seen[-1]) == ["de", "en", "fr"]


def test_texts_of_more_words_than_are_held(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = fit_language_model(docs)
    texts = [r.text for r in docs.limit(40).collect()] + [None, "", "12"]
    names, scores = model.predict(texts, model.table())
    with pytest.MonkeyPatch.context() as patch:
        for most in (1, 50):
            patch.setattr(li, "WORDS_HELD", most)
            model.places, model.rows = {}, None
            got = model.predict(texts, model.table())
            assert got[0] == names and got[1] == pytest.approx(scores)
            assert len(model.places) <= 2 * most + 1
