"""Lookups with defaults: resources, settings, languages, directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import folded, is_blank, or_else


#: The folders that results go to where none is given.
OUTPUT_FOLDERS = {"merged": "Output_LivePhotos", "split": "Output_SplitPhotos", "repaired": "Output_Repaired"}


def resource_text(keys: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``keys`` (key, ...) with text from ``catalogue`` (key, value), or the key where it is missing or blank."""
    found = keys.join(catalogue.select("key", "value"), "key", "left")
    return found.withColumn("text", or_else(F.col("value"), F.col("key"))).drop("value")


def setting(value: Column, kind: str, default: Column) -> Column:
    """A stored setting as ``kind``, or the default where it is missing or of another type."""
    return F.coalesce(value.try_cast(kind), default)


def merged_settings(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Settings (key, value) after the changes (seq, key, value): of a key's values the last one stays."""
    every = stored.select("key", "value", F.lit(-1).cast("long").alias("seq")).union(changes.select("key", "value", F.col("seq").cast("long")))
    return every.groupBy("key").agg(F.max_by("value", "seq").alias("value"))


def language(choice: Column, system: Column) -> Column:
    """1 is Chinese, 2 English; else Chinese if any language of the system is, else English."""
    chinese = F.coalesce(F.exists(system, lambda x: F.lower(x).startswith("zh")), F.lit(False))
    return F.when(choice == 1, "zh-Hans").when(choice == 2, "en-US").when(chinese, "zh-Hans").otherwise("en-US")


def language_tag(override: Column, system: Column) -> Column:
    """The override, else the system's first language, else English."""
    return F.coalesce(F.when(~is_blank(override), override), F.get(system, F.lit(0)), F.lit("en-US"))


def output_dir(given: Column, input_dir: Column, folder: str) -> Column:
    """The given directory, or ``folder`` in the input directory where it is blank."""
    return or_else(given, F.concat(input_dir, F.lit(f"/{folder}")))


def distinct_paths(paths: DataFrame, order: str = "ordinal") -> DataFrame:
    """(path) once for each spelling whatever its case: the first one."""
    return paths.groupBy(folded(F.col("path")).alias("k")).agg(F.min_by("path", order).alias("path")).select("path")
