"""Logs, dumps and session states: the newest, the last ones, and what is still to move or to recover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import is_blank

SESSION = """SessionId string, StartedAt string, LastUpdatedAt string, CleanShutdown boolean, MainWindowCreated boolean,
    IsProcessing boolean, IsPaused boolean, SelectedModeIndex int, ComboTaskCount int, SplitTaskCount int,
    ComboProgress double, SplitProgress double, Breadcrumbs array<string>"""


def is_recovered(name: Column) -> Column:
    return F.contains(F.lower(name), F.lit("-recovered."))


def artifacts(files: DataFrame) -> DataFrame:
    """``files`` (file_name, ...) with kind log, recovered or dump; others are left out.

    Logs are named ``crash-*.log``, dumps ``*.dmp``, whatever their case.
    """
    low = F.lower("file_name")
    kind = F.when(low.like("crash-%.log"), F.when(is_recovered(F.col("file_name")), "recovered").otherwise("log")).when(low.like("%.dmp"), "dump")
    return files.withColumn("kind", kind).where("kind is not null")


def newest_first(files: DataFrame, kind: str) -> DataFrame:
    """The artefacts of a kind by falling time, then falling number."""
    return artifacts(files).where(F.col("kind") == kind).orderBy(F.desc("mtime"), F.desc("ordinal"))


def latest_of_kinds(files: DataFrame) -> DataFrame:
    """The newest artefact of each kind. One row a kind, from a pre-aggregated maximum."""
    row = F.struct("mtime", "ordinal", "file_name")
    best = artifacts(files).groupBy("kind").agg(F.max(row).alias("best"))
    return best.select("kind", "best.mtime", "best.ordinal", "best.file_name")


def latest(files: DataFrame) -> DataFrame:
    """The newest of the newest log, dump and recovered log; of equal times the first named here."""
    prio = F.when(F.col("kind") == "log", 0).when(F.col("kind") == "dump", 1).otherwise(2)
    return latest_of_kinds(files).orderBy(F.desc("mtime"), prio).limit(1)


def last_rows(rows: DataFrame, order: list[Column], n: int = 30) -> DataFrame:
    """The last ``n`` rows in ``order``: a bounded top-k, which no partition answers with more than n rows."""
    return rows.orderBy(*[c.desc() for c in order]).limit(n)


def to_move(old: DataFrame, new: DataFrame) -> DataFrame:
    """The old artefacts whose names aren't in the new place yet."""
    return old.join(new.select("file_name").distinct(), "file_name", "left_anti")


def sessions(rows: DataFrame, column: str = "state") -> DataFrame:
    """``rows`` with session, the parsed JSON document, null where it is missing or broken."""
    return rows.withColumn("session", F.from_json(F.col(column), SESSION, {"mode": "PERMISSIVE"}))


def to_recover(rows: DataFrame) -> Column:
    """Whether a recovered log is due: a state that didn't shut down cleanly, and no pending log."""
    return F.coalesce(F.col("session.SessionId").isNotNull() & ~F.coalesce("session.CleanShutdown", F.lit(False)) & F.col("pending_log").isNull(), F.lit(False))


def existing(paths: DataFrame, listing: DataFrame) -> DataFrame:
    """The rows of ``paths`` whose file_name is neither null nor blank and is in ``listing``."""
    return paths.where(~is_blank(F.col("file_name"))).join(listing.select("file_name").distinct(), "file_name", "left_semi")


def session_documents(states: DataFrame) -> DataFrame:
    """(SessionId, document): of each session the newest state by LastUpdatedAt, then by its JSON, written as JSON."""
    document = F.to_json(F.struct(*[c for c in states.columns]))
    return states.groupBy("SessionId").agg(F.max(F.struct(F.col("LastUpdatedAt"), document.alias("document"))).alias("m")).select(
        "SessionId", F.col("m.document").alias("document")
    )
