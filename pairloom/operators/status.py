"""Status of tasks: what is left to do, progress, and what is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pairloom.functions.indexing import with_row_index
from pairloom.functions.text import is_blank

#: Texts of task states, and colours as alpha, red, green, blue.
STATUS_TEXTS = {"Pending": "Waiting", "Processing": "Processing", "Success": "Done", "Failed": "Failed"}
COLOURS = {"Processing": "255,245,158,11", "Success": "255,16,185,129", "Failed": "255,239,68,68"}
QUIET = ["Skipped", "No repair needed", "Perfect"]


def pending(tasks: DataFrame) -> DataFrame:
    """The tasks that a run of merging or splitting takes up."""
    return tasks.where(F.col("status") != "Success")


def pending_repairs(tasks: DataFrame) -> DataFrame:
    """The tasks that a run of repairing takes up."""
    return tasks.where(F.col("needs_repair") & (F.col("status") != "Success"))


def totals(tasks: DataFrame) -> tuple[int, int]:
    row = tasks.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "Success").alias("done")).first()
    return row["n"], row["done"]


def shown(run: DataFrame, done: Column, total: int) -> DataFrame:
    text = F.concat(done.cast("string"), F.lit(f"/{total}"))
    percent = F.lit(100.0) * done / F.lit(float(total)) if total else F.lit(0.0)
    return run.select("idx", text.alias("progress_text"), percent.alias("progress"))


def split_progress(tasks: DataFrame) -> DataFrame:
    """(idx, progress_text, progress) after each task of a run in order: earlier successes count, too."""
    total, done = totals(tasks)
    run = with_row_index(pending(tasks).select("idx"), [F.col("idx")], "nth")
    return shown(run, F.col("nth") + done, total)


def merge_progress(tasks: DataFrame) -> DataFrame:
    """The same for merging, where skipped successes never count, so a second run doesn't reach 100 %."""
    total, _ = totals(tasks)
    return shown(with_row_index(pending(tasks).select("idx"), [F.col("idx")], "nth"), F.col("nth"), total)


def observed(results: DataFrame, name: str = "run") -> tuple[DataFrame, Observation]:
    """A writer's results (status) and what is counted of them as they pass: total, done, failed.

    The counts come with the first action on the results and cost no pass of their own; a task that ran twice counts once.
    """
    run = Observation(name)
    counts = [F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "Success").alias("done"), F.count_if(F.col("status") == "Failed").alias("failed")]
    return results.observe(run, *counts), run


def repair_progress(tasks: DataFrame) -> DataFrame:
    """The same for repairing: skipped rows count, but only a repaired row shows a new value."""
    total, _ = totals(tasks)
    every = with_row_index(tasks.select("idx", "status", "needs_repair"), [F.col("idx")], "nth")
    return shown(pending_repairs(every), F.col("nth"), total)


def split_display(status: Column, details: Column) -> Column:
    """The details, or the status's text where they are blank."""
    text = status
    for name, value in STATUS_TEXTS.items():
        text = F.when(status == name, value).otherwise(text)
    return F.when(is_blank(details), text).otherwise(details)


def repair_display(status: Column, details: Column) -> Column:
    """Success for every row whose details say that nothing was to do, else the status."""
    quiet = F.lit(False)
    for word in QUIET:
        quiet = quiet | F.coalesce(details.contains(word), F.lit(False))
    return F.when(quiet, "Success").otherwise(status)


def colour(status: Column) -> Column:
    out = F.lit("default")
    for name, value in COLOURS.items():
        out = F.when(status == name, value).otherwise(out)
    return out


def neighbours(tasks: DataFrame, centre: int, forward: bool = True, near: int = 5, far: int = 10) -> DataFrame:
    """The tasks around ``centre`` (0-based) to fetch ahead: ``far`` of them in the direction of scrolling.

    The centre itself is left out, and so are rows that have their picture already.
    """
    low, high = (centre - near, centre + far) if forward else (centre - far, centre + near)
    index = F.col("idx") - 1
    return tasks.where(index.between(low, high) & (index != centre) & ~F.col("has_thumbnail"))


def neighbours_of_all(tasks: DataFrame, centres: list[tuple[int, bool]], near: int = 5, far: int = 10) -> DataFrame:
    """(centre, forward and the columns of ``tasks``): the neighbours of a short list of (centre, forward), in one pass."""
    index = F.col("idx") - 1
    ranges = [(c - near, c + far) if forward else (c - far, c + near) for c, forward in centres]
    listed = F.array(*[
        F.struct(F.lit(c).alias("centre"), F.lit(forward).alias("forward"), F.lit(low).alias("low"), F.lit(high).alias("high"))
        for (c, forward), (low, high) in zip(centres, ranges)
    ])
    around = F.filter(listed, lambda x: index.between(x["low"], x["high"]) & (index != x["centre"]))
    wanted = tasks.where(~F.col("has_thumbnail")).withColumn("_c", F.explode(around))
    return wanted.select(F.col("_c.centre").alias("centre"), F.col("_c.forward").alias("forward"), *tasks.columns)


def applied(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Tasks with a run's results (idx, ok, message): status, progress_text and details."""
    joined = tasks.join(results, "idx", "left")
    ran = F.col("ok").isNotNull()
    return joined.select(
        "idx", F.when(F.col("ok"), "Success").when(ran, "Failed").otherwise(F.col("status")).alias("status"),
        F.when(F.col("ok"), "100%").when(ran, "0%").otherwise(F.when(F.col("status") == "Success", "100%").otherwise("0%")).alias("progress_text"),
        F.coalesce("message", F.lit("")).alias("details"),
    )


def page(tasks: DataFrame, skip: int, take: int) -> DataFrame:
    """The tasks after the first ``skip``, at most ``take`` of them, by their number."""
    first = max(0, skip)
    return tasks.where((F.col("idx") > first) & (F.col("idx") <= first + max(0, take)))


def parallelism(cores: Column, most: int = 20) -> Column:
    """Rows that a run works on at once: a core each, at least 1 and at most ``most``."""
    return F.greatest(F.lit(1), F.least(cores, F.lit(most)))
