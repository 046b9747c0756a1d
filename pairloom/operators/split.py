"""Where the photo ends and the video begins: metadata, plan, and byte ranges."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import base_name, extension, folded
from pairloom.sources.assembly import RECIPE, RECIPE_TYPE, assembled
from pairloom.sources.filesystems import filesystem_of, first_bytes

#: The patterns of the metadata.
OFFSET = r'(?i)GCamera:MicroVideoOffset="([0-9]+)"'
SEMANTIC, LENGTH, MIME = r'(?i)Item:Semantic="MotionPhoto"', r'(?i)Item:Length="([0-9]+)"', r'(?is)Item:Mime="([^"]+)"'
#: The brands of a container that is MP4.
MP4_BRANDS = "^(isom|mp4|avc1|hvc1|hev1)"
#: The part of a file that is searched for metadata.
PREFIX = 1 << 20
OLD_OFFSET, OLD_LENGTH, OLD_SEMANTIC = (re.compile(p.encode(), re.IGNORECASE) for p in ('GCamera:MicroVideoOffset="[0-9]+"', 'Item:Length="[0-9]+"', 'Item:Semantic="MotionPhoto"'))


def item_value(text: Column, pattern: str) -> Column:
    """The value that ``pattern`` has in the first tag of the motion photo's item, or null.

    A value before the item's semantics is the tag's first one, a value after it the last. Tags end at ``>``,
    so each is looked at alone, in time that grows with the text and not with its square.
    """
    tag = F.get(F.filter(F.split(text, ">"), lambda x: x.rlike(SEMANTIC) & x.rlike(pattern)), F.lit(0))
    values = F.regexp_extract_all(tag, F.lit(pattern), F.lit(1))
    before = F.regexp_instr(tag, F.lit(pattern)) < F.regexp_instr(tag, F.lit(SEMANTIC))
    return F.when(before, F.element_at(values, 1)).otherwise(F.element_at(values, -1))


def video_length(text: Column) -> Column:
    """The appended video's bytes, or null: an offset that is no long gives way to the item's length."""
    offset = F.nullif(F.regexp_extract(text, OFFSET, 1), F.lit(""))
    return F.coalesce(offset.try_cast("long"), item_value(text, LENGTH).try_cast("long"))


def video_extension(text: Column, header: Column, chosen: int = 0) -> Column:
    """``.mp4`` if ``chosen`` is 1, ``.mov`` if 2; else by the video's first bytes, then by MIME, else ``.mp4``."""
    if chosen in (1, 2):
        return F.lit({1: ".mp4", 2: ".mov"}[chosen])
    long_enough = F.length(header) >= 12
    box = F.decode(F.substring(header, 5, 4), "ISO-8859-1")
    brand = F.lower(F.decode(F.substring(header, 9, 4), "ISO-8859-1"))
    mime = F.lower(F.trim(item_value(text, MIME)))
    return (
        F.when(long_enough & (box == "ftyp") & brand.startswith("qt"), ".mov")
        .when(long_enough & (box == "ftyp") & brand.rlike(MP4_BRANDS), ".mp4")
        .when(long_enough & (box == "moov"), ".mov")
        .when(mime == "video/quicktime", ".mov")
        .otherwise(".mp4")
    )


def split_plan(files: DataFrame, chosen: int = 0) -> DataFrame:
    """(ordinal, status, image_length, video_length, image_output, video_output) of each file.

    ``files`` has ordinal, file_name, size_bytes, metadata (text of the first bytes), video_header
    (binary) and output_dir, input_dir. The status is empty, no_metadata, bad_length or ok; a plan
    that isn't ok has no outputs. An output that would be the source itself gets a suffix.
    """
    length = video_length(F.col("metadata"))
    name, size = F.col("file_name"), F.col("size_bytes")
    source = F.concat_ws("/", "input_dir", "file_name")
    base = base_name(name)

    def output(suffix: str, ext: Column) -> Column:
        plain = F.concat(F.col("output_dir"), F.lit("/"), base, ext)
        return F.when(folded(plain) == folded(source), F.concat(F.col("output_dir"), F.lit("/"), base, F.lit(suffix), ext)).otherwise(plain)

    own = F.when(extension(name) == "", ".jpg").otherwise(extension(name))
    ok = F.col("status") == "ok"
    planned = files.withColumn("video_length", length).withColumn(
        "status",
        F.when(size <= 0, "empty").when(F.col("video_length").isNull(), "no_metadata")
        .when((F.col("video_length") <= 0) | (size - F.col("video_length") <= 0), "bad_length").otherwise("ok"),
    )
    return planned.select(
        "ordinal", "file_name", "status", F.when(ok, size - F.col("video_length")).alias("image_length"),
        F.when(ok, F.col("video_length")).alias("video_length"), F.when(ok, output("_image", own)).alias("image_output"),
        F.when(ok, output("_video", video_extension(F.col("metadata"), F.col("video_header"), chosen))).alias("video_output"),
    )


def with_video_header(files: DataFrame, size: int = 32) -> DataFrame:
    """``files`` (path, size_bytes, head) with metadata and video_header, read at the video's start.

    Only the header's bytes are read, in the tasks; a file that can't be read has none.
    """
    known = files.withColumn("metadata", F.decode("head", "ISO-8859-1"))
    known = known.withColumn("at", F.col("size_bytes") - video_length(F.col("metadata"))).drop("head")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = zip(batch["path"], batch["at"])
            yield batch.assign(video_header=[first_bytes(path, size, int(at)) if at >= 0 else None for path, at in found])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in known.schema.fields)
    return known.mapInPandas(read, f"{fields}, video_header binary")


def ranged(path: Column, start: Column, length: Column) -> Column:
    """A piece of a file, for :func:`assembled`."""
    return F.struct(path.alias("path"), start.cast("long").alias("start"), length.cast("long").alias("length"), F.lit(None).cast("binary").alias("data"))


def write_splits(plan: DataFrame) -> DataFrame:
    """Writes the files of a plan with source (path): (ordinal, status, details) of each row.

    Rows whose plan isn't ok fail without being tried. Photo and video of a row are written both or neither.
    """
    outputs = F.array(
        F.struct(F.col("image_output").alias("target"), F.array(ranged(F.col("source"), F.lit(0), F.col("image_length"))).alias("pieces")),
        F.struct(F.col("video_output").alias("target"), F.array(ranged(F.col("source"), F.col("image_length"), F.col("video_length"))).alias("pieces")),
    )
    ok = F.col("status") == "ok"
    return assembled(plan.select("ordinal", F.when(~ok, F.col("status")).alias("problem"), F.when(ok, outputs).alias("outputs")))


def old_lengths(head: bytes) -> list[tuple[int, int]]:
    """The places of video lengths in a photo's metadata: offsets, and in each tag what spans an item's length and semantics."""
    spans = [m.span() for m in OLD_OFFSET.finditer(head)]
    start = 0
    while start < len(head):
        end = head.find(b">", start)
        end = len(head) if end < 0 else end
        lengths = [m.span() for m in OLD_LENGTH.finditer(head, start, end)]
        marks = [m.span() for m in OLD_SEMANTIC.finditer(head, start, end)] if lengths else []
        if marks:
            spans.append((lengths[0][0], marks[-1][1]) if lengths[0] < marks[0] else (marks[0][0], lengths[-1][1]))
        start = end + 1
    return sorted(spans)


def merge_pieces(image: str, video: str) -> list[tuple]:
    """(path, start, length, data) of a photo's bytes with the video's length in their first PREFIX, and then of the video's.

    Old lengths are blanked, so no other byte moves; the new one stands in a comment segment after the start marker.
    """
    system, place = filesystem_of(video)
    length = system.get_file_info(place).size
    if length is None:
        raise OSError(f"{video} isn't there")
    if not length:
        raise ValueError("the video is empty")
    head = first_bytes(image, PREFIX)
    if head is None:
        raise OSError(f"{image} can't be read")
    if head[:2] != b"\xff\xd8":
        raise ValueError("no JPEG: the video's length has no place")
    note = b'GCamera:MicroVideoOffset="%d"' % length
    out = [(None, None, None, b"\xff\xd8\xff\xfe" + (len(note) + 2).to_bytes(2, "big") + note)]
    at = 2
    for start, end in old_lengths(head):
        start = max(start, at)
        if end > start:
            out += [(image, at, start - at, None), (None, None, None, b" " * (end - start))]
            at = end
    return [*out, (image, at, None, None), (video, 0, length, None)]


def write_merges(pairs: DataFrame) -> DataFrame:
    """Writes image and video of each row (ordinal, image, video, output) into one file: (ordinal, status, details).

    The layout is this library's own, the inverse of splitting: the image's bytes, then the
    video's, whose length stands in a comment segment after the JPEG's start marker. Lengths that the
    image's metadata already has are blanked. An image that is no JPEG, or an empty video, fails.
    """

    def recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out = {"ordinal": row["ordinal"], "problem": None, "outputs": None}
                try:
                    pieces = [dict(zip(("path", "start", "length", "data"), p)) for p in merge_pieces(row["image"], row["video"])]
                    out["outputs"] = [{"target": row["output"], "pieces": pieces}]
                except (OSError, ValueError) as error:
                    out["problem"] = str(error)
                yield pa.RecordBatch.from_pylist([out], RECIPE_TYPE)

    own = pairs.select(F.col("ordinal").cast("long").alias("ordinal"), "image", "video", "output")
    return assembled(own.mapInArrow(recipes, RECIPE))
