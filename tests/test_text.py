"""Sizes as texts, at the halves between two texts and at large sizes."""

import duckdb
from pyspark.sql import functions as F

from pairloom.functions import text
from pairloom.plans import oracle

UNITS = [1024**n for n in range(5)]


def shown(spark, column, sizes):
    return [r.shown for r in spark.createDataFrame(enumerate(sizes), "i INT, size BIGINT").orderBy("i").select(column(F.col("size")).alias("shown")).collect()]


def by_sql(function, sizes):
    rows = ", ".join(f"({i}, CAST({'NULL' if s is None else s} AS BIGINT))" for i, s in enumerate(sizes))
    return [r[0] for r in duckdb.sql(f"SELECT {function('size')} FROM (VALUES {rows}) t(i, size) ORDER BY i").fetchall()]


def test_sizes_just_below_a_half_are_rounded_down(spark):
    # 0.025 MiB are 26,214.4 bytes: 0.4 bytes less is under the half by less than a millionth of a MiB
    assert shown(spark, text.byte_size, [1048576 + 26214, 1048576 + 26215]) == ["1.02 MB", "1.03 MB"]


def test_byte_sizes_equal_sql_around_every_half(spark):
    halves = [(unit * (2 * n + 1)) // 200 for unit in UNITS[1:] for n in (100, 101, 102, 468, 20944, 39694, 102398, 102399)]
    edges = [s for unit in UNITS for s in (unit, 1024 * unit)]
    sizes = [s + d for s in halves + edges for d in (-1, 0, 1)] + [None, -1, 0, 2**53 + 1, 2**63 - 1]
    assert shown(spark, text.byte_size, sizes) == by_sql(oracle.byte_size, sizes)


def test_byte_sizes_beyond_64_bits(spark):
    size = F.col("size").cast("decimal(38,0)")
    frame = spark.createDataFrame([(str(2**64 - 1),), (str(10**30),), (str(10**35),)], "size STRING")
    found = [r[0] for r in frame.select(text.byte_size(size)).collect()]
    assert found == ["16777216.00 TB", "909494701772928237.92 TB", "90949470177292823791503.91 TB"]


def test_short_sizes_equal_sql_beyond_a_doubles_digits(spark):
    # the largest sizes that stay under a half, times 200, in 64 bits, where doubles are 512 apart
    large = [(2097152 * n - 1048576) // 200 + d for n in range(4 * 10**12, 4 * 10**12 + 50) for d in (-1, 0, 1, 2)]
    sizes = [None, 0, 51, 52, 1048575, 1048576, *large]
    assert shown(spark, text.kb_or_mb, sizes) == by_sql(oracle.kb_or_mb, sizes)
