"""The corpus pipeline: language ID, near-dedup, secret scan and packing of ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import stored
from pairloom.llm.jaccard import jaccard_components, row_hash
from pairloom.llm.language_id import fit_language_model, identify
from pairloom.llm.packing import pack_documents
from pairloom.llm.secret_scan import fit_secret_model, redact_secrets

TOKENS_PER_SEQUENCE = 2048


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language the model, learnt from the labelled ones, accepts.

    Rejected are null texts, texts without a letter, and those whose calibrated score is under the
    model's threshold.
    """
    others = [c for c in docs.columns if c != "text"]
    shown = identify(docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("others"), "text"), fit_language_model(docs))
    return shown.where(~F.col("lang_rejected")).select(*[F.col("text") if c == "text" else F.col("others").getField(c).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: that of the smallest doc_id, null ids last.

    Documents link where their sets of five-word shingles have a Jaccard similarity of 0.8 or more.
    Only rows of one group are dropped: those that repeat an id with another text stay.
    """
    groups = jaccard_components(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row"))
    kept = groups.groupBy("component", "alone").agg(first.alias("first")).select("first.row")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), row_hash(docs).alias("row"))
    return own.join(kept, "row").dropDuplicates(["row"]).select(*[F.col("own").getField(c).alias(c) for c in docs.columns])


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents; every secret that the patterns or the network find gives way to its kind's name."""
    return redact_secrets(docs, fit_secret_model(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), TOKENS_PER_SEQUENCE)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: None of the stages can be expressed in SQL: each applies a trained model, XXH64 or a search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
