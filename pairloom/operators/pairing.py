"""Pairs of images and videos that share a base name, whatever its case."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.indexing import with_row_index
from pairloom.functions.text import base_name, ends_with_any, folded, kb_or_mb

IMAGES, VIDEOS = [".jpg", ".jpeg"], [".mov", ".mp4"]


def one_per_key(files: DataFrame, endings: list[str], side: str) -> DataFrame:
    """The files of a kind, one for each key: the last path and size, the first spelling and place."""
    kind = files.where(ends_with_any(F.col("file_name"), endings))
    key = folded(base_name(F.col("file_name"))).alias("key")
    return kind.groupBy(key).agg(
        F.max_by("file_name", "ordinal").alias(f"{side}_name"), F.max_by("size_bytes", "ordinal").alias(f"{side}_size"),
        F.min_by(base_name(F.col("file_name")), "ordinal").alias(f"{side}_base"), F.min("ordinal").alias(f"{side}_first"),
    )


def pairs(files: DataFrame) -> DataFrame:
    """(base_name, image_name, video_name, image_size, video_size, first_ordinal) of each pair."""
    image, video = one_per_key(files, IMAGES, "image"), one_per_key(files, VIDEOS, "video")
    return image.join(video, "key").select(
        F.col("image_base").alias("base_name"), "image_name", "video_name", "image_size", "video_size",
        F.col("image_first").alias("first_ordinal"),
    )


def pair_counts(files: DataFrame) -> DataFrame:
    """One row: pairs, lone_images, lone_videos. A name that a later one replaced counts nowhere."""
    image, video = one_per_key(files, IMAGES, "image"), one_per_key(files, VIDEOS, "video")
    both = image.join(video, "key", "full_outer")
    has_image, has_video = F.col("image_first").isNotNull(), F.col("video_first").isNotNull()
    return both.agg(
        F.count_if(has_image & has_video).alias("pairs"), F.count_if(has_image & ~has_video).alias("lone_images"),
        F.count_if(has_video & ~has_image).alias("lone_videos"),
    )


def merge_tasks(files: DataFrame) -> DataFrame:
    """The numbered merge tasks of the pairs, in the order in which their images were first seen."""
    found = with_row_index(pairs(files), [F.col("first_ordinal")])
    return found.select(
        "idx", "base_name", "image_name", "video_name", kb_or_mb(F.col("image_size")).alias("image_size_text"),
        kb_or_mb(F.col("video_size")).alias("video_size_text"), (F.col("image_size") + F.col("video_size")).alias("total_size_bytes"),
        F.lit("Pending").alias("status"),
    )
