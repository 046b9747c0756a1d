"""Tables written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Has Spark delete an execution's shuffle files as it ends; else they stay until the driver's JVM collects garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where it is unset and Spark runs in one process, as in tests, a temporary one; on a cluster that
    would be another folder on each machine, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir is unset; on {master} it has to name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """``df``, written once as Parquet in the shared folder and read again.

    This cuts the lineage: a lost executor costs the tasks of a later step only, and a
    frame that several steps need is computed once. ``instead_of``, an earlier table of this
    function that no later step reads, is deleted after that. The shuffle files of the
    write are deleted when it ends, as no other step can read them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANED)
    spark.conf.set(CLEANED, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANED, before)
    if instead_of is not None:
        discard(instead_of)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(table: DataFrame) -> None:
    """Deletes a table that :func:`stored` gave."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
