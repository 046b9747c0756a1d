"""The queries over the driver's tables, and their SQL for a second engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import text
from pairloom.functions.indexing import with_row_index
from pairloom.operators import artifacts, lookup, pairing, recognise, repair, split, status
from pairloom.plans import oracle
from pairloom.sources import derived

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = oracle.SQL


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def pair_scan(spark, sf_dir):
    return with_row_index(pairing.pairs(derived.media_files(spark, sf_dir)), [F.col("first_ordinal")])


@query
def pair_counts(spark, sf_dir):
    return pairing.pair_counts(derived.media_files(spark, sf_dir))


@query
def merge_tasks(spark, sf_dir):
    return pairing.merge_tasks(derived.media_files(spark, sf_dir))


@query
def size_format(spark, sf_dir):
    files = derived.media_files(spark, sf_dir)
    size = F.col("size_bytes") * F.when(F.col("ordinal") % 7 == 0, -1).when(F.col("ordinal") % 7 == 1, 1000).otherwise(1)
    return files.select("ordinal", text.kb_or_mb(F.col("size_bytes")).alias("short_text"), text.byte_size(size).alias("long_text"))


@query
def name_truncate(spark, sf_dir):
    name = F.col("file_name")
    return derived.tasks(spark, sf_dir).select(
        "idx", text.base_name(name).alias("base"), text.extension(name).alias("ext"), text.shortened(name).alias("merge_name"),
        text.shortened(name, head=21).alias("repair_name"),
    )


@query
def recognise_scan(spark, sf_dir):
    return recognise.split_tasks(derived.media_heads(spark, sf_dir))


@query
def recognise_counts(spark, sf_dir):
    return recognise.recognition_counts(derived.media_heads(spark, sf_dir))


@query
def split_length(spark, sf_dir):
    return derived.media_heads(spark, sf_dir).select("ordinal", split.video_length(F.col("metadata")).alias("video_length"))


@query
def video_extension(spark, sf_dir):
    args = F.col("metadata"), F.col("video_header")
    return derived.media_heads(spark, sf_dir).select(
        "ordinal", *[split.video_extension(*args, n).alias(name) for n, name in enumerate(("detected", "as_mp4", "as_mov"))]
    )


@query
def split_plan(spark, sf_dir):
    return split.split_plan(derived.media_heads(spark, sf_dir))


@query
def repair_classify(spark, sf_dir):
    found = repair.described(repair.analysed(derived.exif_photos(spark, sf_dir)))
    return found.select("ordinal", "issue_type", "rotation_angle", "needs_repair", "issue_description")


@query
def repair_tags_wrapped(spark, sf_dir):
    found = repair.described(repair.analysed(derived.exif_photos(spark, sf_dir)), "zh", per_line=2)
    return found.select("ordinal", "issue_description")


@query
def repair_counts(spark, sf_dir):
    return repair.repair_counts(derived.exif_photos(spark, sf_dir))


@query
def repair_plan(spark, sf_dir):
    plan = repair.repair_plan(derived.exif_photos(spark, sf_dir), F.col("output_dir"))
    lines = F.transform("commands", lambda c: F.array_join(c, " "))
    return plan.select("ordinal", "target", F.array_join(lines, "; ").alias("commands"))


@query
def repair_tasks(spark, sf_dir):
    return repair.repair_tasks(derived.exif_photos(spark, sf_dir))


@query
def pending_filter(spark, sf_dir):
    tasks = derived.tasks(spark, sf_dir)
    todo = status.pending(tasks).select("idx", F.lit("run").alias("kind"))
    return todo.union(status.pending_repairs(tasks).select("idx", F.lit("repair").alias("kind")))


@query
def progress_split(spark, sf_dir):
    return status.split_progress(derived.tasks(spark, sf_dir))


@query
def progress_merge(spark, sf_dir):
    return status.merge_progress(derived.tasks(spark, sf_dir))


@query
def progress_repair(spark, sf_dir):
    return status.repair_progress(derived.tasks(spark, sf_dir))


@query
def display_status(spark, sf_dir):
    state, details = F.col("status"), F.col("details")
    return derived.tasks(spark, sf_dir).select(
        "idx", status.split_display(state, details).alias("split_text"), status.repair_display(state, details).alias("repair_status"),
        status.colour(state).alias("colour"),
    )


@query
def applied_results(spark, sf_dir):
    tasks = derived.tasks(spark, sf_dir)
    results = status.pending(tasks).where(F.col("idx") % 2 == 0).select("idx", (F.col("idx") % 4 == 0).alias("ok"), F.concat(F.lit("m"), "idx").alias("message"))
    return status.applied(tasks.drop("details"), results)


@query
def prefetch_window(spark, sf_dir):
    return status.neighbours_of_all(derived.tasks(spark, sf_dir), [(0, True), (700, True), (700, False), (1498, True)]).select(
        "centre", "forward", "idx", "file_name"
    )


@query
def latest_artifact(spark, sf_dir):
    return artifacts.latest(derived.artifact_files(spark, sf_dir)).select("kind", "file_name")


@query
def latest_of_kinds(spark, sf_dir):
    return artifacts.latest_of_kinds(derived.artifact_files(spark, sf_dir)).select("kind", "ordinal", "file_name")


@query
def recovered_logs(spark, sf_dir):
    return artifacts.newest_first(derived.artifact_files(spark, sf_dir), "recovered").select("ordinal", "file_name")


@query
def last_30_events(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), "event_type")
    return artifacts.last_rows(events, [F.col("ts"), F.col("event_id")]).select("event_id", line.alias("line"))


@query
def legacy_anti_join(spark, sf_dir):
    files = derived.artifact_files(spark, sf_dir)
    logs = artifacts.artifacts(files).where("kind = 'log'")
    return artifacts.to_move(logs, logs.where(F.col("ordinal") % 3 == 0)).select("ordinal", "file_name")


@query
def session_recovery(spark, sf_dir):
    i = F.col("event_id")
    state = (
        F.when(i % 5 == 0, F.concat(F.lit('{"SessionId":"s'), i.cast("string"), F.lit('","CleanShutdown":false,"ComboTaskCount":'), (i % 9).cast("string"), F.lit(',"Breadcrumbs":["a","b"]}')))
        .when(i % 5 == 1, F.concat(F.lit('{"SessionId":"s'), i.cast("string"), F.lit('","CleanShutdown":true}')))
        .when(i % 5 == 2, F.lit("{broken")).when(i % 5 == 3, F.concat(F.lit('{"SessionId":"s'), i.cast("string"), F.lit('"}')))
    )
    pending = F.when(i % 4 == 0, F.concat(F.lit("crash-"), i.cast("string"), F.lit(".log")))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", state.alias("state"), pending.alias("pending_log"))
    found = artifacts.sessions(rows)
    return found.select(
        "event_id", artifacts.to_recover(found).alias("recover"), F.col("session.ComboTaskCount").cast("long").alias("tasks"),
        F.coalesce(F.array_join("session.Breadcrumbs", ","), F.lit("")).alias("breadcrumbs"),
    )


@query
def resource_lookup(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey")
    region = spark.read.parquet(f"{sf_dir}/region.parquet").where("r_regionkey <> 2")
    catalogue = region.select(F.concat(F.lit("key_"), F.col("r_regionkey").cast("string")).alias("key"), F.when(F.col("r_regionkey") == 3, " ").otherwise(F.col("r_name")).alias("value"))
    keys = nation.select("n_nationkey", F.concat(F.lit("key_"), F.col("n_regionkey").cast("string")).alias("key"))
    return lookup.resource_text(keys, catalogue).select("n_nationkey", "key", "text")


@query
def setting_default(spark, sf_dir):
    i = F.col("c_custkey")
    value = F.when(i % 4 == 0, i.cast("string")).when(i % 4 == 1, "true").when(i % 4 == 2, "zh-Hans")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", value.alias("value"))
    return rows.select(
        "c_custkey", lookup.setting(F.col("value"), "int", F.lit(-1)).cast("long").alias("as_int"),
        lookup.setting(F.when(i % 4 != 0, F.col("value")), "boolean", F.lit(False)).alias("as_bool"),
        lookup.setting(F.col("value"), "string", F.lit("none")).alias("as_text"),
    )


@query
def settings_upsert(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    key = F.concat(F.lit("k"), F.col("user_id").cast("string"))
    stored = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_mktsegment").alias("value"))
    return lookup.merged_settings(stored, events.select(F.col("event_id").alias("seq"), key.alias("key"), F.col("event_type").alias("value")))


@query
def language_resolve(spark, sf_dir):
    i = F.col("s_suppkey")
    system = F.when(i % 5 == 0, F.array(F.lit("fr-FR"), F.lit("ZH-hant"))).when(i % 5 == 1, F.array(F.lit("zh-CN"))).when(i % 5 == 2, F.array(F.lit("de"))).otherwise(F.array().cast("array<string>"))
    override = F.when(i % 7 == 0, "ja").when(i % 7 == 1, " ")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", (i % 3).alias("choice"), system.alias("system"), override.alias("override"))
    return rows.select("s_suppkey", lookup.language(F.col("choice"), F.col("system")).alias("language"), lookup.language_tag(F.col("override"), F.col("system")).alias("tag"))


@query
def output_dirs(spark, sf_dir):
    i = F.col("s_suppkey")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.when(i % 3 == 0, "/mine").when(i % 3 == 1, "  ").alias("given"), F.concat(F.lit("/d"), i.cast("string")).alias("input"))
    return rows.select("s_suppkey", *[
        lookup.output_dir(F.col("given"), F.col("input"), folder).alias(name)
        for name, folder in lookup.OUTPUT_FOLDERS.items()
    ])


@query
def distinct_paths(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    path = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "/In/P").otherwise("/in/p"), F.col("o_custkey").cast("string"))
    return lookup.distinct_paths(orders.select(F.col("o_orderkey").alias("ordinal"), path.alias("path")))


@query
def time_format(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "value", "user_id")
    seconds = F.floor(F.col("value") * 1000 + F.col("user_id") * 86000)
    return events.select(
        "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("shown"), F.date_format("ts", "yyyyMMdd-HHmmss-SSS").alias("in_name"),
        text.duration(seconds).alias("lasted"), text.iso_time(F.col("ts")).alias("iso"),
    )


@query
def name_folding(spark, sf_dir):
    names = derived.named_people(spark, sf_dir).withColumn("key", text.folded(F.col("name")))
    same = names.groupBy("key").agg(F.count("*").alias("n_same"), F.min_by("name", "ordinal").alias("first_name"))
    placed = with_row_index(names.withColumn("place", text.sort_key(F.col("name"))), [F.col("place"), F.col("ordinal")])
    return placed.join(same, "key").select("ordinal", "idx", "name", "first_name", "n_same")


@query
def name_template(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey")
    return nation.select(
        "n_nationkey", text.formatted(F.lit("{1}: {0} of {1}"), F.col("n_name"), F.col("n_regionkey")).alias("line"),
        text.or_unknown(F.when(F.col("n_nationkey") % 3 == 0, " ").otherwise(F.col("n_name"))).alias("known"),
    )


@query
def number_template(spark, sf_dir):
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal", "c_name")
    line = text.formatted(F.lit("{0:F1} of {1}, {{0}} {0:F2} {2} {3}"), F.col("c_acctbal"), F.concat(F.lit("{0}"), "c_name"), F.lit(None).cast("string"))
    return customer.select("c_custkey", line.alias("line"))


@query
def orientation_kinds(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    i = F.col("p_partkey")
    kinds = ['"Rotate 90 CW"', "6", "true", "null", '["Rotate 90"]', '{"a":"90"}', "-1.5", '""', "false"]
    value = F.element_at(F.array(*[F.lit(x) for x in kinds]), (i % len(kinds) + 1).cast("int"))
    exif = F.concat(F.lit('[{"ImageWidth":4,"ImageHeight":3,"Orientation":'), value, F.lit("}]"))
    return repair.analysed(part.select("p_partkey", exif.alias("exif"))).select("p_partkey", "issue_type", "rotation_angle")


@query
def existing_paths(spark, sf_dir):
    files = derived.artifact_files(spark, sf_dir)
    wanted = files.select("ordinal", F.when(F.col("ordinal") % 4 == 0, " ").when(F.col("ordinal") % 4 == 1, F.lit(None)).otherwise(F.col("file_name")).alias("file_name"))
    return artifacts.existing(wanted, artifacts.artifacts(files).where("kind <> 'dump'")).select("ordinal", "file_name")


@query
def session_documents(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    states = events.select(
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("SessionId"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("LastUpdatedAt"),
        (F.col("event_type") == "view").alias("CleanShutdown"), F.col("event_id").cast("int").alias("ComboTaskCount"),
        F.array("event_type").alias("Breadcrumbs"),
    )
    found = artifacts.sessions(artifacts.session_documents(states), "document")
    return found.select(
        "SessionId", F.col("session.ComboTaskCount").cast("long").alias("tasks"), F.col("session.CleanShutdown").alias("clean"),
        F.array_join("session.Breadcrumbs", ",").alias("breadcrumbs"),
    )


@query
def task_page(spark, sf_dir):
    tasks = status.page(derived.tasks(spark, sf_dir), 995, 10)
    return tasks.select("idx", "file_name", status.parallelism(F.col("idx") - 990).alias("parallelism"))
