"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.storage import shared_dir, stored

__all__ = ["BYTE_PATTERN", "bounded_batches", "byte_characters", "byte_text", "crc_of_id", "forest", "has_long_blanks", "in_blocks", "joined_small", "shared_dir", "sliced", "spread_join", "stored"]

#: The pre-token pattern of byte-level vocabularies, a fixed value.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of white space of so many characters go to the ``tokenizers`` library, as the pattern of ``tiktoken`` backtracks over a run.
LONG_BLANKS = 10_000
BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{64,}+")
#: Of whole texts, so many bytes and rows are worked on at once.
SLICE_BYTES, SLICE_ROWS = 4_000_000, 512
BATCH_BYTES = 8_000_000
#: A side of a join that has at most so many rows is broadcast; rows of one key that a join keeps together.
BROADCAST_ROWS, ROWS_TOGETHER = 200_000, 5_000


def byte_text(column: str = "text") -> Column:
    """The UTF-8 bytes of a text; a null text is empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def crc_of_id(column: str = "doc_id") -> Column:
    """CRC-32 of an id written in decimal; it deals documents into folds."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def in_blocks(size: Column, rows_per_block: int) -> Column:
    """The number of blocks that a group of ``size`` rows is cut into."""
    return F.ceil(size / F.lit(rows_per_block)).cast("int")


def bounded_batches(spark: SparkSession) -> None:
    """Has the session hand texts to Python in batches of BATCH_BYTES, unless it was given a size of its own.

    Spark's 64 MB are held twice by the executor and once by its worker, for each task.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of about SLICE_BYTES, whatever the batches' own size; a slice has one row at least."""
    for batch in batches:
        rows = max(1, min(SLICE_ROWS, SLICE_BYTES * max(1, batch.num_rows) // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def joined_small(big: DataFrame, small: DataFrame, key: str | list[str], how: str = "inner", salt: Column | None = None) -> DataFrame:
    """``big`` joined to the stored table ``small``, which is broadcast if its count of rows allows that.

    A larger one is joined through a shuffle; rows of hot keys are dealt by ``salt`` (see
    :func:`spread_join`), or are left to adaptive execution without one.
    """
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), key, how)
    return big.join(small, key, how) if salt is None else spread_join(big, small, key, salt, how)


def spread_join(
    big: DataFrame, small: DataFrame, key: str | list[str], salt: Column, how: str = "inner", sizes: DataFrame | None = None
) -> DataFrame:
    """``big`` joined to ``small`` (a row for each key); rows of a hot key are dealt by ``salt`` over several tasks.

    A key is hot if over ROWS_TOGETHER rows of ``big``, a stored table, have it. There is at most one for
    so many rows; that list is broadcast. Rows of ``small`` are repeated for the parts of their key.
    ``sizes`` (the key, _n) are the rows of each key, where they are known already.
    """
    keys = [key] if isinstance(key, str) else key
    sizes = big.groupBy(*keys).agg(F.count("*").alias("_n")) if sizes is None else sizes
    hot = sizes.where(F.col("_n") > ROWS_TOGETHER)
    hot = stored(hot.select(*keys, in_blocks(F.col("_n"), ROWS_TOGETHER).alias("_parts")), "hot-keys")
    if not hot.limit(1).count():
        return big.join(small, keys, how)
    parts = F.coalesce("_parts", F.lit(1))
    dealt = big.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(salt), parts).cast("int")).drop("_parts")
    many = small.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(many, [*keys, "_salt"], how).drop("_salt")


def byte_characters() -> dict[str, int]:
    """The byte that each printable character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


def has_long_blanks(text: str) -> bool:
    """Whether a run of white space has LONG_BLANKS characters or more."""
    return len(text) >= LONG_BLANKS and any(m.end() - m.start() >= LONG_BLANKS for m in BLANKS.finditer(text))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star forest of the graph with links ``a[i]`` - ``b[i]``.

    Returns (node, root) for each node that is not a root; a root is the smallest
    node of its component. Labels sink along links and jump to their own labels,
    so the number of passes grows with the logarithm of the longest path.
    """
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = inverse[: len(a)], inverse[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        sunk = label.copy()
        np.minimum.at(sunk, label[left], low)
        np.minimum.at(sunk, label[right], low)
        np.minimum.at(sunk, left, low)
        np.minimum.at(sunk, right, low)
        sunk = sunk[sunk]
        if np.array_equal(sunk, label):
            break
        label = sunk
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]
