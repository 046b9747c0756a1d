"""Product codes of vectors: codebooks refined in rounds, nearest entries found by a kd-tree for each codebook.

The trees are broadcast each round. A search goes down to the nearer side first and looks at another side
only while its box is no farther than the best entry so far; a box as far away is visited, too, if it
holds a lower index, so ties go to the lowest one. Sums of parts are whole numbers, added up by Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import BROADCAST_ROWS, sliced, spread_join, stored
from pairloom.llm.integer_vectors import EXACT, matrix, usable, whole

#: Entries of a tree's leaf.
LEAF = 8
#: Components below this are compared in longs, others in integers of any size.
EXACT_IN_LONGS = 1 << 28


@dataclass
class Tree:
    """A node: its box, its lowest index, and either its entries' indexes or two sides."""

    low: np.ndarray
    high: np.ndarray
    first: int
    own: np.ndarray | None = None
    left: Tree | None = None
    right: Tree | None = None


def grown(entries: np.ndarray, own: np.ndarray) -> Tree:
    """The tree over the entries ``own`` (rising indexes), cut at the median of the widest dimension."""
    box = entries[own]
    node = Tree(box.min(0), box.max(0), int(own[0]))
    if len(own) <= LEAF:
        node.own = own
        return node
    widest = int(np.argmax([int(b) - int(a) for a, b in zip(node.low, node.high)]))
    order = own[np.argsort(box[:, widest], kind="stable")]
    node.left, node.right = grown(entries, np.sort(order[: len(order) // 2])), grown(entries, np.sort(order[len(order) // 2:]))
    return node


class Codebook:
    """The entries of one part of vectors, and their kd-tree."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.tree = grown(entries, np.arange(len(entries)))
        self.fits = bool((np.abs(entries.astype(float)) < EXACT_IN_LONGS).all())

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the index of its nearest entry and the squared distance, exact."""
        kind = np.int64 if self.fits and (np.abs(x.astype(float)) < EXACT_IN_LONGS).all() else object
        x, entries = x.astype(kind), self.entries.astype(kind)
        best = np.full(len(x), np.iinfo(np.int64).max, np.int64) if kind is np.int64 else np.full(len(x), 1 << 200, object)
        index = np.full(len(x), len(entries))

        def bound(node: Tree, rows: np.ndarray) -> np.ndarray:
            away = np.maximum(np.maximum(node.low.astype(kind) - x[rows], x[rows] - node.high.astype(kind)), 0)
            return (away * away).sum(1)

        def open_rows(node: Tree, rows: np.ndarray, distance: np.ndarray) -> np.ndarray:
            closer = (distance < best[rows]) | ((distance == best[rows]) & (node.first < index[rows]))
            return rows[closer.astype(bool)]

        def visit(node: Tree, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if node.own is not None:
                away = x[rows, None, :] - entries[node.own]
                distance = (away * away).sum(2)
                found = distance.argmin(1)
                distance, found = distance[np.arange(len(rows)), found], node.own[found]
                better = ((distance < best[rows]) | ((distance == best[rows]) & (found < index[rows]))).astype(bool)
                best[rows[better]], index[rows[better]] = distance[better], found[better]
                return
            left, right = bound(node.left, rows), bound(node.right, rows)
            near = (left <= right).astype(bool)
            visit(node.left, open_rows(node.left, rows[near], left[near]))
            visit(node.right, open_rows(node.right, rows[near], right[near]))
            visit(node.right, open_rows(node.right, rows[~near], right[~near]))
            visit(node.left, open_rows(node.left, rows[~near], left[~near]))

        visit(self.tree, np.arange(len(x)))
        return index, best


@dataclass
class Codebooks:
    """A codebook for each part of vectors of ``size`` components, a multiple of the number of parts."""

    books: list[Codebook]
    size: int
    scale: int

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return np.split(x, len(self.books), axis=1)

    def sha256(self) -> str:
        """Of all entries' components in decimal, by part, entry and place, with commas between them."""
        return hashlib.sha256(",".join(str(int(v)) for b in self.books for row in b.entries for v in row).encode()).hexdigest()


def whole_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    return vectors.where(usable()).select(F.col("vec_id").cast("long").alias("vec_id"), "label", whole("embedding", scale).alias("x"))


def refined(x: DataFrame, codebooks: Codebooks) -> Codebooks:
    """One round: each entry becomes the floored mean of the parts nearest to it; an unused one stays."""
    width, entries = codebooks.size // len(codebooks.books), len(codebooks.books[0].entries)
    shared = x.sparkSession.sparkContext.broadcast(codebooks)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        # The first number of an entry is its count.
        sums = np.zeros((len(own.books), entries, 1 + width), object)
        for batch in sliced(batches):
            for part, (book, values) in enumerate(zip(own.books, own.parts(matrix(batch.column(0), own.size)))):
                index, _ = book.nearest(values)
                sums[part, :, 0] += np.bincount(index, minlength=entries).astype(object)
                if np.abs(values.astype(float)).sum() < 2.0**53:
                    added = [np.bincount(index, weights=column, minlength=entries).astype(np.int64) for column in values.T]
                    sums[part, :, 1:] += np.column_stack(added).astype(object)
                else:
                    np.add.at(sums[part, :, 1:], index, values.astype(object))
        used = np.flatnonzero(sums[:, :, 0].astype(bool).repeat(1 + width))
        values = pa.array([int(v) for v in sums.ravel()[used]], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(used), values], ["place", "value"])

    added = x.select("x").mapInArrow(of, f"place long, value {EXACT}").groupBy("place").agg(F.sum("value").alias("value")).collect()
    sums = np.zeros(len(codebooks.books) * entries * (1 + width), object)
    for r in added:
        sums[r["place"]] = int(r["value"])
    books = []
    for book, own in zip(codebooks.books, sums.reshape(len(codebooks.books), entries, 1 + width)):
        new = book.entries.copy()
        for n, (count, *total) in enumerate(own):
            if count:
                new[n] = [v // count for v in total]
        books.append(Codebook(new))
    return Codebooks(books, codebooks.size, codebooks.scale)


def fit_codebooks(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> Codebooks | None:
    """The codebooks after ``rounds`` rounds over all ``vectors`` (vec_id, label, embedding), or None where none can be used.

    They start as the parts of the ``entries`` smallest vec_ids, ties by the vector's components, null ids last. Codebooks and a
    sum for each of their numbers are all that reaches the driver.
    """
    x = whole_vectors(vectors, scale)
    size = x.agg(F.max(F.size("x")).alias("size")).first()["size"]
    if size is None:
        return None
    size = max(parts, -(-size // parts) * parts)
    first = x.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    start = np.array([list(r["x"]) + [0] * (size - len(r["x"])) for r in first], np.int64)
    codebooks = Codebooks([Codebook(part) for part in np.split(start, parts, axis=1)], size, scale)
    for _ in range(rounds):
        codebooks = refined(x, codebooks)
    return codebooks


def coded(vectors: DataFrame, codebooks: Codebooks) -> DataFrame:
    """(vec_id, label, code, error): the index of each part's nearest entry in two hex digits, and the squared distances' sum.

    ``error`` has up to 38 digits, null beyond. Vectors that can't be used are left out; longer ones than the codebooks' are cut.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(codebooks)
    x = whole_vectors(vectors, codebooks.scale)
    kind = x.schema["label"].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in sliced(batches):
            values = matrix(batch.column(2), own.size)
            found = [book.nearest(part) for book, part in zip(own.books, own.parts(values))]
            codes = np.column_stack([index for index, _ in found]).astype(np.uint8)
            errors = sum(distance.astype(object) for _, distance in found)
            error = pa.array([int(v) if v < 10**38 else None for v in errors], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([row.tobytes().hex() for row in codes], pa.string()), error], ["vec_id", "label", "code", "error"])

    cut = x.withColumn("x", F.slice("x", 1, codebooks.size))
    return cut.mapInArrow(of, f"vec_id long, label {kind}, code string, error {EXACT}")


def vector_codes(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each row of (vec_id, embedding, label) whose vector can be used.

    Null vectors and those with null or non-finite components are left out. Components become floor(scale * x); shorter vectors, and
    sizes that ``parts`` doesn't divide, count as filled up with zeros. Repeated rows and null ids stay. ``label_error``
    adds up the errors of equal labels, null ones together. Errors have up to 38 digits, null beyond. Other
    columns are ignored; an empty table gives no rows. ``entries`` is 256 at most, as an index has two hex digits.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an index of two hex digits names 256 entries at most")
    codebooks = fit_codebooks(vectors, parts, entries, rounds, scale)
    if codebooks is None:
        none = f"CAST(NULL AS {EXACT})"
        return vectors.where("false").selectExpr("CAST(vec_id AS LONG) AS vec_id", "'' AS code", f"{none} AS error", f"{none} AS label_error", "'' AS codebooks_sha256")
    rows = stored(coded(vectors, codebooks), "vector-codes")
    known, none = rows.where("label IS NOT NULL"), rows.where("label IS NULL")
    total = F.when(F.count_if(F.col("error").isNull()) == 0, F.try_sum("error")).cast(EXACT).alias("label_error")
    sums = stored(known.groupBy("label").agg(total), "label-errors")
    few = sums.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = known.join(F.broadcast(sums), "label") if few else spread_join(known, sums, "label", F.struct("vec_id", "code"))
    alone = none.withColumn("label_error", F.lit(none.agg(total).first()["label_error"]).cast(EXACT))
    names = ["vec_id", "code", "error", "label_error"]
    shown = joined.select(*names).union(alone.select(*names))
    return shown.withColumn("codebooks_sha256", F.lit(codebooks.sha256()))
