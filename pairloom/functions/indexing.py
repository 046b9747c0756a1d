"""A global row index without a global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.storage import stored


def with_row_index(df: DataFrame, order: list[Column], name: str = "idx") -> DataFrame:
    """``df`` with ``name``, the 1-based place of each row in ``order`` (a total order).

    Rows are range-partitioned and sorted, and numbered inside their partition; the sizes of the
    partitions before it, of which the driver fetches one number a partition, are added. A window
    without a partition would sort all rows in one task.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The written table fixes the partitions, which a sample chose.
    placed = stored(ranged.withColumn("_at", F.monotonically_increasing_id()), "row-index")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()
    offsets, total = [], 0
    for row in sizes:
        offsets.append((row["_part"], total))
        total += row["n"]
    before = df.sparkSession.createDataFrame(offsets, "_part long, _before long")
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return placed.join(F.broadcast(before), "_part").withColumn(name, place.cast("long")).drop("_at", "_part", "_before")
