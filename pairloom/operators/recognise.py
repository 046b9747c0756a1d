"""Files that hold a photo and a video in one, known by name or by markers in their first bytes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.indexing import with_row_index
from pairloom.functions.text import ends_with_any, kb_or_mb, sort_key

#: Markers in the metadata, looked for as they are written.
MARKERS = ["GCamera:MotionPhoto", "GCamera:MicroVideo", "MicroVideoOffset", "Container:Directory", "MotionPhoto"]
CANDIDATES = [".jpg", ".jpeg"]


def known_by_name(name: Column) -> Column:
    low = F.lower(name)
    return low.startswith("mvimg_") | ends_with_any(name, [".mp.jpg", ".mp.jpeg"])


def recognised(name: Column, size: Column, head: Column) -> Column:
    """A known name decides first, even of an empty file; then size; then any marker in the head (binary)."""
    marked = reduce(Column.__or__, [F.contains(head, F.lit(m).cast("binary")) for m in MARKERS])
    return F.when(known_by_name(name), F.lit(True)).when(size <= 0, F.lit(False)).otherwise(F.coalesce(marked, F.lit(False)))


def candidates(files: DataFrame) -> DataFrame:
    kind = files.where(ends_with_any(F.col("file_name"), CANDIDATES))
    return kind.withColumn("recognised", recognised(F.col("file_name"), F.col("size_bytes"), F.col("head")))


def split_tasks(files: DataFrame) -> DataFrame:
    """The recognised files by name, whatever its case, numbered; equal names in the order of listing."""
    found = candidates(files).where("recognised").select("ordinal", "file_name", "size_bytes").withColumn("k", sort_key(F.col("file_name")))
    return with_row_index(found, [F.col("k"), F.col("ordinal")]).select(
        "idx", "file_name", kb_or_mb(F.col("size_bytes")).alias("size_text"), F.lit("0%").alias("progress_text"), F.lit("Pending").alias("status")
    )


def recognition_counts(files: DataFrame) -> DataFrame:
    """One row: recognised and skipped candidates; other files count in neither."""
    return candidates(files).agg(F.count_if(F.col("recognised")).alias("recognised"), F.count_if(~F.col("recognised")).alias("skipped"))
