"""Files put together from byte ranges of other files, as a committed Spark sink.

A task writes beside each target a part that has the attempt's own name, so attempts at the same task, speculative
ones or such after a failure, never write to one file. Parts are moved to their targets when Spark commits the job, and only
those of the attempts that it counts; the parts of all others are deleted, then or on abort. Before a part
is made its name goes to the attempt's intents, so those of attempts that died are found, too.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from pairloom.functions.storage import shared_dir
from pairloom.sources.filesystems import filesystem_of

CHUNK = 1 << 20
#: Moves that the driver has under way at once.
MOVES = 32
PIECES = "array<struct<path:string,start:long,length:long,data:binary>>"
PIECE_TYPE = pa.struct([("path", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("data", pa.binary())])
RECIPE_TYPE = pa.schema([("ordinal", pa.int64()), ("problem", pa.string()), ("outputs", pa.list_(pa.struct([("target", pa.string()), ("pieces", pa.list_(PIECE_TYPE))])))])
RECIPE = f"ordinal long, problem string, outputs array<struct<target:string,pieces:{PIECES}>>"


def append_pieces(write, pieces: list[Row]) -> None:
    """Copies pieces in chunks: given bytes, or a range of a file, to its end if length is null. An early end is an error."""
    for piece in pieces:
        if piece["data"] is not None:
            write.write(bytes(piece["data"]))
            continue
        system, place = filesystem_of(piece["path"])
        with system.open_input_file(place) as read:
            read.seek(piece["start"])
            left = piece["length"]
            while left is None or left:
                data = read.read(CHUNK if left is None else min(CHUNK, left))
                if not data:
                    if left is None:
                        break
                    raise OSError(f"{piece['path']} ends {left} bytes early")
                write.write(data)
                left = left if left is None else left - len(data)


def remove(path: str) -> None:
    system, place = filesystem_of(path)
    if system.get_file_info(place).type == fs.FileType.File:
        system.delete_file(place)


@dataclass
class Attempt(WriterCommitMessage):
    name: str


class AssemblyWriter(DataSourceWriter):
    def __init__(self, job: str):
        self.job = job

    def attempts(self) -> tuple[fs.FileSystem, str]:
        system, place = filesystem_of(self.job)
        return system, f"{place}/attempts"

    def write(self, iterator: Iterator[Row]) -> Attempt:
        context = TaskContext.get()
        name = f"{context.partitionId()}-{context.taskAttemptId()}-" if context else ""
        name += uuid.uuid4().hex
        system, place = self.attempts()
        with system.open_output_stream(f"{place}/{name}.intents") as intents, system.open_output_stream(f"{place}/{name}.rows") as rows:
            for row in iterator:
                moves, status, details = [], "Failed", row["problem"] or ""
                if row["problem"] is None:
                    try:
                        for output in row["outputs"]:
                            target, part = output["target"], f"{output['target']}.{name}.part"
                            intents.write(json.dumps(part).encode() + b"\n")
                            intents.flush()
                            moves.append([part, target])
                            own, where = filesystem_of(part)
                            own.create_dir(where.rpartition("/")[0], recursive=True)
                            with own.open_output_stream(where) as write:
                                append_pieces(write, output["pieces"])
                        status = "Success"
                    except (OSError, ValueError) as error:
                        # A row's outputs are all there or none.
                        for part, _ in moves:
                            remove(part)
                        moves, details = [], str(error)
                rows.write(json.dumps({"ordinal": row["ordinal"], "status": status, "details": details, "moves": moves}).encode() + b"\n")
        return Attempt(name)

    def commit(self, messages: list[Attempt | None]) -> None:
        system, place = self.attempts()
        counted = [m.name for m in messages if m]
        with ThreadPoolExecutor(MOVES) as pool:
            for name in counted:
                with system.open_input_stream(f"{place}/{name}.rows") as rows:
                    for _ in pool.map(self.move, [tuple(m) for line in rows.read().splitlines() for m in json.loads(line)["moves"]]):
                        pass
                system.move(f"{place}/{name}.rows", f"{place}/../committed/{name}.json")
                system.delete_file(f"{place}/{name}.intents")
        self.abort([])

    @staticmethod
    def move(names: tuple[str, str]) -> None:
        (system, part), (_, target) = filesystem_of(names[0]), filesystem_of(names[1])
        system.move(part, target)

    def abort(self, messages: list[Attempt | None]) -> None:
        """Deletes the parts of all attempts that aren't committed."""
        system, place = self.attempts()
        for info in system.get_file_info(fs.FileSelector(place, allow_not_found=True)):
            if info.base_name.endswith(".intents"):
                with system.open_input_stream(info.path) as intents:
                    for line in intents.read().splitlines():
                        remove(json.loads(line))
                system.delete_file(info.path)


class FileAssembly(DataSource):
    """Rows of RECIPE: ``problem``, if it isn't null, says why a row fails untried. Option ``job`` names the job's folder."""

    @classmethod
    def name(cls) -> str:
        return "file_assembly"

    def schema(self) -> str:
        return RECIPE

    def writer(self, schema: StructType, overwrite: bool) -> AssemblyWriter:
        return AssemblyWriter(self.options["job"])


def assembled(recipes: DataFrame) -> DataFrame:
    """Writes the files of ``recipes`` (RECIPE): (ordinal, status, details) of each row.

    Bytes go from file to file inside the tasks and never through a shuffle. A row that fails says why and
    harms no other; its targets stay as they were. Results are those of committed attempts, so a task that
    ran twice counts once. Missing folders are made. Writing again gives the same files.
    """
    spark = recipes.sparkSession
    spark.dataSource.register(FileAssembly)
    job = f"{shared_dir(spark)}/assembly-{uuid.uuid4().hex}"
    system, place = filesystem_of(job)
    for folder in ("attempts", "committed"):
        system.create_dir(f"{place}/{folder}", recursive=True)
    rows = recipes.selectExpr("CAST(ordinal AS LONG) AS ordinal", "problem", f"CAST(outputs AS array<struct<target:string,pieces:{PIECES}>>) AS outputs")
    rows.write.format("file_assembly").mode("append").option("job", job).save()
    return spark.read.schema("ordinal long, status string, details string").json(f"{job}/committed")
