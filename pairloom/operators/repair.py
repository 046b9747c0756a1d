"""Photos whose stored pixels disagree with their orientation: classification and repair plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import ends_with_any, formatted, is_blank

CANDIDATES = [".jpg", ".jpeg", ".heic"]
FIELDS = "array<struct<ImageWidth:string,ImageHeight:string,Orientation:string,ThumbnailImage:string>>"
#: The names of findings in either language.
TAGS = {
    "en": {"wide": "Horizontally stretched", "tall": "Vertically stretched", "angle": "With {0}° rotation label", "no_angle": "Missing rotation label", "thumb": "Extra thumbnail", "perfect": "No repair needed"},
    "zh": {"wide": "像素横向拉伸", "tall": "像素纵向拉伸", "angle": "带 {0}° 旋转标签", "no_angle": "缺失旋转标签", "thumb": "多余缩略图", "perfect": "无需修复"},
}


def parsed(exif: Column) -> Column:
    """struct(valid, width, height, orientation, has_thumbnail) of an EXIF reader's JSON: an array of one object.

    Width and height may be numbers or numbers in quotes; anything else is 0. A thumbnail is there
    if its key is, even if null. Text that is no array of an object, or whose orientation is
    there, not null and no string, isn't valid.
    """
    one = F.get(F.from_json(exif, FIELDS), F.lit(0))
    inner = F.regexp_replace(exif, r"^\s*\[|\]\s*$", "")
    kind = F.schema_of_variant(F.variant_get(F.try_parse_json(exif), "$[0].Orientation", "variant"))
    valid = F.coalesce(F.trim(exif).startswith("[") & one.isNotNull() & F.coalesce(kind.isin("STRING", "VOID"), F.lit(True)), F.lit(False))
    return F.struct(
        valid.alias("valid"),
        F.coalesce(one["ImageWidth"].try_cast("int"), F.lit(0)).alias("width"),
        F.coalesce(one["ImageHeight"].try_cast("int"), F.lit(0)).alias("height"),
        F.coalesce(one["Orientation"], F.lit("")).alias("orientation"),
        F.coalesce(F.array_contains(F.json_object_keys(inner), "ThumbnailImage"), F.lit(False)).alias("has_thumbnail"),
    )


def angle_of(orientation: Column) -> Column:
    """90 if the text contains it, else 180, else 270, else 0, in this order."""
    out = F.when(orientation.contains("90"), 90)
    return out.when(orientation.contains("180"), 180).when(orientation.contains("270"), 270).otherwise(0)


def analysed(photos: DataFrame, exif: str = "exif", facts: Column | None = None) -> DataFrame:
    """``photos`` with issue_type, rotation_angle, needs_repair and tags (array of keys of TAGS).

    Wider than high needs rebuilding, whatever the angle; higher than wide only with an angle; a
    square one is judged by its thumbnail alone, but a thumbnail with an angle needs rebuilding.
    A thumbnail without either needs stripping. Metadata that can't be read is an Error, which
    doesn't count as broken. ``facts``, what :func:`parsed` would give, takes the place of the JSON in column ``exif``.
    """
    named = photos.withColumn("_e", parsed(F.col(exif)) if facts is None else facts).withColumn("_angle", angle_of(F.col("_e.orientation")))
    w, h, thumb, angle = F.col("_e.width"), F.col("_e.height"), F.col("_e.has_thumbnail"), F.col("_angle")
    wide, tall = w > h, (w < h) & (angle > 0)
    tags = F.array_compact(F.array(
        F.when(wide, "wide").when(tall, "tall"),
        F.when(wide & (angle == 0), "no_angle").when(wide | tall, "angle"),
        F.when(thumb, "thumb"),
    ))
    named = named.withColumn("tags", F.when(F.col("_e.valid"), tags).otherwise(F.array().cast("array<string>")))
    some = F.size("tags") > 0
    issue = F.when(~F.col("_e.valid"), "Error").when(~some, "Perfect").when(wide | (angle > 0), "NeedsRebuild").otherwise("NeedsStrip")
    return named.withColumns({
        "issue_type": issue, "rotation_angle": F.when(F.col("_e.valid") & some, angle).otherwise(0),
    }).withColumn("needs_repair", F.col("issue_type").isin("NeedsStrip", "NeedsRebuild")).drop("_e", "_angle")


def described(photos: DataFrame, language: str = "en", per_line: int | None = None) -> DataFrame:
    """Analysed ``photos`` with issue_description: bracketed tags, all in one line or ``per_line`` to a line."""
    words = TAGS[language]
    table = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    shown = F.transform("tags", lambda t: F.concat(F.lit("["), formatted(table[t], F.col("rotation_angle")), F.lit("]")))
    if per_line is None:
        text = F.array_join(shown, " ")
    else:
        starts = F.when(F.size(shown) > 0, F.sequence(F.lit(0), F.size(shown) - 1, F.lit(per_line))).otherwise(F.array().cast("array<int>"))
        text = F.array_join(F.transform(starts, lambda i: F.array_join(F.slice(shown, i + 1, per_line), " ")), "\n")
    return photos.withColumn(
        "issue_description", F.when(F.col("issue_type") == "Perfect", f"[{words['perfect']}]").otherwise(text)
    )


def repair_counts(photos: DataFrame) -> DataFrame:
    """One row: total, broken and normal candidates; unreadable ones are normal."""
    kind = analysed(photos.where(ends_with_any(F.col("file_name"), CANDIDATES)))
    return kind.agg(
        F.count("*").alias("total"), F.count_if(F.col("needs_repair")).alias("broken"), F.count_if(~F.col("needs_repair")).alias("normal")
    )


def repair_plan(photos: DataFrame, output_dir: Column) -> DataFrame:
    """(ordinal, target, commands) of each photo that needs repair; commands are argument lists in order.

    A blank ``output_dir`` repairs in place. Rebuilding turns the pixels by the angle, then copies the
    tags without thumbnail and orientation; stripping drops the thumbnail only. The result is
    written beside the target and then moved over it.
    """
    source = F.concat_ws("/", "input_dir", "file_name")
    target = F.when(is_blank(output_dir), source).otherwise(F.concat_ws("/", output_dir, "file_name"))
    temp = F.concat(target, F.lit(".tmp_repair"))
    rebuild = F.array(
        F.array(F.lit("rotate"), F.col("rotation_angle").cast("string"), source, temp),
        F.array(F.lit("copy_tags"), source, temp), F.array(F.lit("drop"), F.lit("ThumbnailImage"), F.lit("Orientation"), temp),
        F.array(F.lit("move"), temp, target),
    )
    strip = F.array(
        F.array(F.lit("copy"), source, temp), F.array(F.lit("drop"), F.lit("ThumbnailImage"), temp), F.array(F.lit("move"), temp, target)
    )
    return analysed(photos).where("needs_repair").select(
        "ordinal", target.alias("target"), F.when(F.col("issue_type") == "NeedsRebuild", rebuild).otherwise(strip).alias("commands")
    )


def repair_tasks(photos: DataFrame) -> DataFrame:
    """(ordinal, file_name, status, needs_repair, details) of each candidate, before any repair."""
    kind = analysed(photos.where(ends_with_any(F.col("file_name"), CANDIDATES)))
    return kind.select(
        "ordinal", "file_name", F.lit("Pending").alias("status"), "needs_repair",
        F.when(F.col("needs_repair"), "Waiting for repair").otherwise("Skipped").alias("details"),
    )
