"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.bpe import bpe_digests
from pairloom.llm.fingerprints import fingerprint_edits
from pairloom.llm.language_id import language_predictions
from pairloom.llm.language_model import language_model_scores
from pairloom.llm.packing import pack_documents
from pairloom.llm.secret_scan import fit_secret_model, secret_spans
from pairloom.llm.simhash import simhash_components
from pairloom.llm.suffix_dedup import repeat_digests
from pairloom.llm.token_counts import edit_token_counts, sample_edits
from pairloom.llm.url_filter import judged_urls
from pairloom.llm.vector_codes import vector_codes
from pairloom.llm.vector_dedup import vector_components
from pairloom.llm.whitening import fit_whitening, whiten


#: (verdict, host, path)
URL_RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)


def op1_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.93)


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=5, w=16)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return edit_token_counts(docs, sample_edits(F.col("text")), public_tokenizers.path("byte_bpe_50k.json"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), radius=4, words_per_shingle=4)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return secret_spans(docs, fit_secret_model(docs))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_predictions(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), burn_in=2, samples=2)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = whiten(vectors, fit_whitening(vectors, components=4, scale=256))
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), length=100)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), parts=16, entries=64, rounds=2, scale=256)
    return rows.withColumns({c: F.col(c).try_cast("long") for c in ("error", "label_error")})


QUERIES = {
    "op1_vector_dedup": op1_vector_dedup,
    "op2_winnowing": op2_winnowing,
    "op3_token_counts": op3_token_counts,
    "op4_url_filter": op4_url_filter,
    "op5_simhash": op5_simhash,
    "op6_packing": op6_packing,
    "op7_secret_scan": op7_secret_scan,
    "op8_language_id": op8_language_id,
    "op9_language_model": op9_language_model,
    "op10_bpe": op10_bpe,
    "op11_whitening": op11_whitening,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_vector_codes": op13_vector_codes,
}

#: Only the vector links can be said in SQL, by comparing all pairs; the other operators apply XXH64,
#: vocabularies, searches or trained models, and are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_vector_dedup": """
WITH RECURSIVE fine AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
reached AS (
  SELECT a, b FROM links
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
components AS (SELECT a, min(b) AS low FROM reached GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n, 0) AS n_links, least(v.vec_id, coalesce(low, v.vec_id)) AS component_id,
  v.vec_id <= coalesce(low, v.vec_id) AS kept
FROM embeddings v LEFT JOIN counts ON counts.a = v.vec_id LEFT JOIN components ON components.a = v.vec_id
""",
}
