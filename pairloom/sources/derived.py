"""Media-shaped relations made of the driver's tables, by expressions that a second engine knows, too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that differ in case outside ASCII, or only seem to.
NAMES = ["straße", "STRASSE", "STRAẞE", "İl", "il", "ıl", "ſet", "SET", "𐐨b", "𐐀B", "\uff5az", "éa", "ÉA", "ǆ", "Ǆ", "µ", "Μ", "\u212a", "k", "_"]
SUFFIXES = [".JPG", ".jpeg", ".mov", ".MP4", ".png"]


def media_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ordinal, file_name, size_bytes, mtime) from orders; one file for each name, whatever its case."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    kind = F.col("o_orderkey") % 5
    suffix = F.element_at(F.array(*[F.lit(x) for x in SUFFIXES]), (kind + 1).cast("int"))
    name = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "IMG_").otherwise("img_"), F.lpad(F.col("o_custkey").cast("string"), 6, "0"), suffix)
    size = F.floor("o_totalprice").cast("long") * F.when(F.col("o_orderkey") % 3 == 0, 16).otherwise(1)
    every = orders.select(
        F.col("o_orderkey").alias("ordinal"), name.alias("file_name"), size.cast("long").alias("size_bytes"), F.col("o_orderdate").alias("mtime")
    )
    first = F.min_by(F.struct("file_name", "size_bytes", "mtime"), "ordinal").alias("f")
    return every.groupBy(F.lower("file_name").alias("k")).agg(F.min("ordinal").alias("ordinal"), first).select(
        "ordinal", "f.file_name", "f.size_bytes", "f.mtime"
    )


def media_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ordinal, file_name, size_bytes, metadata, head, video_header, input_dir, output_dir) from documents' ids and sizes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars")
    i = F.col("doc_id")
    number = i.cast("string")
    name = F.concat(
        F.when(i % 7 == 0, "MVIMG_").when(i % 7 == 1, "_pic").otherwise("Pic"), number,
        F.when(i % 11 == 0, ".MP.jpg").when(i % 11 == 1, ".png").when(i % 11 == 2, ".JPEG").otherwise(".jpg"),
    )
    length = (F.col("n_chars") + F.when(i % 9 == 0, 5000).otherwise(100)).cast("string")
    mime = F.when(i % 4 == 0, "video/quicktime").when(i % 4 == 1, " Video/MP4 ").otherwise("other")
    metadata = (
        F.when(i % 5 == 0, F.concat(F.lit('<x GCamera:MicroVideoOffset="'), length, F.lit('"/>')))
        .when(i % 5 == 1, F.concat(F.lit('<i Item:Semantic="MotionPhoto" Item:Mime="'), mime, F.lit('" Item:Length="'), length, F.lit('"/>')))
        .when(i % 5 == 2, F.concat(F.lit('<i item:length="'), length, F.lit('"\n item:mime="'), mime, F.lit('" item:semantic="motionphoto"/>')))
        .when(i % 5 == 3, F.concat(F.lit('<x GCamera:MicroVideoOffset="99999999999999999999"/><i Item:Length="'), length, F.lit('" Item:Semantic="MotionPhoto"/>')))
        .otherwise(F.lit("<x gcamera:microvideo/>"))
    )
    header = F.concat(
        F.lit("0000"), F.when(i % 6 < 4, "ftyp").when(i % 6 == 4, "moov").otherwise("free"),
        F.when(i % 8 < 2, "qt  ").when(i % 8 < 4, "isom").when(i % 8 == 4, "MP42").when(i % 8 == 5, "hev1").otherwise("heic"),
    )
    size = F.when(i % 13 == 0, 0).otherwise(F.col("n_chars") + 1000)
    return docs.select(
        i.alias("ordinal"), name.alias("file_name"), size.cast("long").alias("size_bytes"), metadata.alias("metadata"),
        metadata.cast("binary").alias("head"),
        F.when(i % 10 == 0, F.substring(header, 1, 8)).otherwise(header).cast("binary").alias("video_header"),
        F.lit("/in").alias("input_dir"), F.when(i % 3 == 0, "/IN").otherwise("/out").alias("output_dir"),
    )


def exif_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ordinal, file_name, exif, input_dir, output_dir) from part; all cells of the truth table occur, and broken JSON."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    i, s = F.col("p_partkey"), F.col("p_size")
    width = F.when(i % 3 == 0, (s + 10).cast("string")).when(i % 3 == 1, F.concat(F.lit('"'), s.cast("string"), F.lit('"'))).otherwise(s.cast("string"))
    height = F.when(i % 3 == 1, s + 10).otherwise(s)
    turn = F.when(i % 4 == 1, ',"Orientation":"Rotate 90 CW"').when(i % 4 == 2, ',"Orientation":"Rotate 180"').when(i % 4 == 3, ',"Orientation":"Rotate 270 CW"').otherwise("")
    thumb = F.when(F.floor(i / 12) % 2 == 0, ',"ThumbnailImage":null').otherwise("")
    exif = F.concat(F.lit('[{"ImageWidth":'), width, F.lit(',"ImageHeight":'), height.cast("string"), turn, thumb, F.lit("}]"))
    broken = F.when(i % 97 == 5, "File not found").when(i % 97 == 6, '[{"ImageWidth":1,"ImageHeight":2,"Orientation":6}]').otherwise(exif)
    name = F.concat(F.lit("p"), i.cast("string"), F.when(i % 10 == 0, ".heic").when(i % 10 == 1, ".png").otherwise(".JPG"))
    return part.select(
        i.alias("ordinal"), name.alias("file_name"), broken.alias("exif"), F.lit("/in").alias("input_dir"),
        F.when(i % 2 == 0, "/out").otherwise(" ").alias("output_dir"),
    )


def artifact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ordinal, file_name, mtime) from events: logs, dumps, recovered logs and others."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type")
    number, kind = F.col("event_id").cast("string"), F.col("event_type")
    name = (
        F.when(kind == "error", F.concat(F.lit("crash-"), number, F.lit(".log")))
        .when(kind == "click", F.concat(F.lit("app."), number, F.lit(".DMP")))
        .when(kind == "view", F.concat(F.lit("Crash-"), number, F.lit("-Recovered.LOG")))
        .otherwise(F.concat(F.lit("note-"), number, F.lit(".txt")))
    )
    return events.select(F.col("event_id").alias("ordinal"), name.alias("file_name"), F.col("ts").alias("mtime"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, file_name, status, needs_repair, has_thumbnail, details) from orders."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    i = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "Failed").when(F.col("o_orderstatus") == "P", "Success").otherwise("Pending")
    details = F.when(i % 6 == 0, "Skipped").when(i % 6 == 1, "[No repair needed]").when(i % 6 == 2, "  ").when(i % 6 == 3, F.lit(None)).otherwise(F.concat(F.lit("done "), i.cast("string")))
    return orders.select(
        (i + 1).alias("idx"), F.concat(F.lit("IMG_"), F.repeat(F.lit("long"), (i % 12).cast("int")), i.cast("string"), F.lit(".MP.jpg")).alias("file_name"),
        status.alias("status"), (i % 3 != 0).alias("needs_repair"), (i % 4 == 0).alias("has_thumbnail"), details.alias("details"),
    )


def named_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ordinal, name) from customer: NAMES, each with a number that several share."""
    i = F.col("c_custkey")
    name = F.element_at(F.array(*[F.lit(x) for x in NAMES]), (i % len(NAMES) + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(i.alias("ordinal"), F.concat(name, F.floor(i / (3 * len(NAMES))).cast("string")).alias("name"))
