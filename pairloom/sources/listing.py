"""Directory listings as a Spark data source.

Spark's own file readers leave out hidden files, names that begin with an underscore and
files without bytes, all of which a media catalogue has to list.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from zlib import crc32

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from pairloom.functions.indexing import with_row_index
from pairloom.sources.filesystems import filesystem_of, first_bytes

PREFIX_BYTES = 1 << 20
#: Directories have tasks of their own up to so many; beyond, a task has DIRECTORIES_TOGETHER, or more where MOST_TASKS is reached.
OWN_TASKS, DIRECTORIES_TOGETHER, MOST_TASKS = 64, 16, 10_000
#: Heads that are held at once.
HEADS_TOGETHER = 16


class Share(InputPartition):
    """Some directories with their ranks, each with the share ``part`` of ``parts`` of its names."""

    def __init__(self, directories: list[tuple[int, str]], part: int, parts: int):
        self.directories, self.part, self.parts = directories, part, parts


class ListingReader(DataSourceReader):
    """Lists directories in the tasks; the driver knows their names only, never those of files."""

    def __init__(self, directories: list[str], shares: int, prefix_bytes: int, columns: list[str]):
        self.directories, self.shares, self.prefix_bytes, self.columns = directories, shares, prefix_bytes, columns
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes comparisons of suffix and size_bytes, which are never null; all others stay with Spark."""
        kinds = {EqualTo: "=", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for one in filters:
            name = getattr(one, "attribute", None)
            if type(one) is IsNotNull and name in (("suffix",), ("size_bytes",)):
                continue
            if type(one) in kinds and name in (("suffix",), ("size_bytes",)):
                self.tests.append((name[0], kinds[type(one)], one.value))
            else:
                yield one

    def passes(self, suffix: str, size: int) -> bool:
        values = {"suffix": suffix, "size_bytes": size}
        for name, kind, other in self.tests:
            own = values[name]
            if kind == "in" and own not in other:
                return False
            if kind == "=" and own != other or kind == ">" and not own > other or kind == ">=" and not own >= other:
                return False
            if kind == "<" and not own < other or kind == "<=" and not own <= other:
                return False
        return True

    def partitions(self) -> list[Share]:
        known = [(rank, d) for rank, d in enumerate(self.directories) if d.strip()]
        tasks = max(1, min(max(min(len(known), OWN_TASKS), len(known) // DIRECTORIES_TOGETHER), MOST_TASKS // self.shares))
        dealt = [known[len(known) * i // tasks: len(known) * (i + 1) // tasks] for i in range(tasks)] if known else []
        return [Share(some, part, self.shares) for some in dealt for part in range(self.shares)]

    def read(self, partition: Share | None) -> Iterator[tuple]:
        # Spark asks for one unnamed partition where there are none.
        if partition is None:
            return
        for rank, directory in partition.directories:
            system, place = filesystem_of(directory)
            # A file in a directory's place has no files, as a missing directory.
            if system.get_file_info(place).type != fs.FileType.Directory:
                continue
            for info in system.get_file_info(fs.FileSelector(place, allow_not_found=True)):
                name = info.base_name
                if info.type != fs.FileType.File or crc32(name.encode("utf-8", "surrogateescape")) % partition.parts != partition.part:
                    continue
                dot = name.rfind(".")
                suffix = name[dot:].lower() if dot >= 0 else ""
                if not self.passes(suffix, info.size):
                    continue
                path = f"{directory.rstrip('/')}/{name}"
                row = {"directory_rank": rank, "path": path, "file_name": name, "suffix": suffix, "size_bytes": info.size, "mtime": info.mtime}
                if "head" in self.columns:
                    row["head"] = first_bytes(path, self.prefix_bytes)
                yield tuple(row[c] for c in self.columns)


class MediaListing(DataSource):
    """All files of the directories in option ``paths`` (one a line), without their subdirectories.

    A missing or blank directory has no files. ``suffix`` is the last suffix in lower case with its dot; comparisons of it and of
    size_bytes are made before a row is. The column head, the first ``prefix_bytes`` bytes (null if they can't be
    read), is there only if a schema asks for it; without it no file is opened. ``shares`` cuts
    each directory into so many tasks by a hash of names, for directories of millions of files.
    """

    @classmethod
    def name(cls) -> str:
        return "media_listing"

    def schema(self) -> str:
        return "directory_rank int, path string, file_name string, suffix string, size_bytes long, mtime timestamp"

    def reader(self, schema: StructType) -> ListingReader:
        options = self.options
        return ListingReader(options["paths"].split("\n"), int(options.get("shares", "1")), int(options.get("prefix_bytes", PREFIX_BYTES)), schema.fieldNames())


PUSH_DOWN = "spark.sql.python.filterPushdown.enabled"


def with_heads(files: DataFrame, prefix_bytes: int) -> DataFrame:
    """``files`` (path) with head, the first bytes of each, read in the tasks; null if they can't be read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, HEADS_TOGETHER):
                part = batch.slice(at, HEADS_TOGETHER)
                paths = part.column(part.schema.get_field_index("path")).to_pylist()
                heads = pa.array([first_bytes(p, prefix_bytes) for p in paths], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, heads], [*part.schema.names, "head"])

    return files.mapInArrow(read, StructType(files.schema.fields[:]).add("head", "binary"))


def list_files(
    spark: SparkSession, *directories: str, prefix_bytes: int = 0, suffixes: list[str] | None = None, least_size: int | None = None, shares: int = 1
) -> DataFrame:
    """(ordinal, path, file_name, size_bytes, mtime, head) of the files in ``directories``.

    Directories are listed by the tasks. The ordinal is the rank, from 0, of a file's directory and name among the files
    listed: those of ``suffixes`` (lower case, with dots) and of at least ``least_size`` bytes, which the source itself leaves
    out otherwise. The head has ``prefix_bytes`` first bytes; it is null, and no file is opened, without.
    """
    spark.dataSource.register(MediaListing)
    before = spark.conf.get(PUSH_DOWN, "false")
    spark.conf.set(PUSH_DOWN, "true")
    try:
        files = spark.read.format("media_listing").option("paths", "\n".join(directories)).option("shares", str(shares)).load()
        if suffixes is not None:
            files = files.where(F.col("suffix").isin(suffixes))
        if least_size is not None:
            files = files.where(F.col("size_bytes") >= least_size)
        placed = with_row_index(files.drop("suffix"), [F.col("directory_rank"), F.col("file_name")], "ordinal")
    finally:
        spark.conf.set(PUSH_DOWN, before)
    placed = placed.select((F.col("ordinal") - 1).alias("ordinal"), "path", "file_name", "size_bytes", "mtime")
    return with_heads(placed, prefix_bytes) if prefix_bytes else placed.withColumn("head", F.lit(None).cast("binary"))
