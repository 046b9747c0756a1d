"""Whitening of vectors by the exact integer scatter of their distinct values.

Components become whole numbers. Tasks subtract a shift, split what is left into digits of 20 bits, and add up sums
and cross-products of digits by matrix products that double precision holds exactly; blocks are carried over into
integers of any size. Those of all tasks are added by Spark as limbs of 32 bits. The scatter
n·XᵀX - SSᵀ is formed from whole numbers alone and becomes floating-point only to be decomposed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import sliced, stored
from pairloom.llm.integer_vectors import EXACT, matrix, usable, whole

#: Digits' bits, rows whose products of digits (of 42 bits) stay within 2^53 together, and blocks that a long holds the sum of.
DIGIT, BLOCK, CARRY = 20, 1 << 11, 1 << 9
#: Limbs of 32 bits of a sum: products of 126 bits over 2^60 rows fit.
LIMBS = 7
#: Rows of which the shift is the median.
SHIFT_ROWS = 1000


def digits(x: np.ndarray, count: int) -> list[np.ndarray]:
    """``x`` as sum of digit k times 2^(DIGIT k); the last digit has the sign."""
    parts = [((x >> (DIGIT * k)) & ((1 << DIGIT) - 1)).astype(float) for k in range(count - 1)]
    return [*parts, (x >> (DIGIT * (count - 1))).astype(float)]


def digits_needed(x: np.ndarray) -> int:
    """How many digits hold every number of ``x``."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    return next(k for k in range(1, 5) if -(1 << (DIGIT * k)) <= low and high < 1 << (DIGIT * k))


class Scatter:
    """Exact sums and cross-products of rows less ``shift``."""

    def __init__(self, shift: np.ndarray):
        self.shift, size = shift, len(shift)
        self.rows, self.sums, self.products = 0, np.zeros(size, object), np.zeros((size, size), object)
        self.held: dict[tuple[int, int], np.ndarray] = {}
        self.held_sums: dict[int, np.ndarray] = {}
        self.blocks = 0

    def add(self, x: np.ndarray) -> None:
        for at in range(0, len(x), BLOCK):
            own = x[at: at + BLOCK]
            count = max(digits_needed(own), digits_needed(self.shift))
            # Digit by digit, a difference needs no more bits than a long has.
            parts = [a - b for a, b in zip(digits(own, count), digits(self.shift, count))]
            for i, a in enumerate(parts):
                self.held_sums[i] = self.held_sums.get(i, 0) + a.sum(0).astype(np.int64)
                for j in range(i, count):
                    self.held[i, j] = self.held.get((i, j), 0) + (a.T @ parts[j]).astype(np.int64)
            self.rows += len(own)
            self.blocks += 1
            if self.blocks % CARRY == 0:
                self.carry()

    def carry(self) -> None:
        for i, own in self.held_sums.items():
            self.sums += own.astype(object) << (DIGIT * i)
        for (i, j), own in self.held.items():
            own = own.astype(object)
            self.products += (own if i == j else own + own.T) << (DIGIT * (i + j))
        self.held, self.held_sums = {}, {}

    def numbers(self) -> list[int]:
        """The number of rows, the sums, and the products on and above the diagonal."""
        self.carry()
        return [self.rows, *self.sums, *self.products[np.triu_indices(len(self.shift))]]


def limbs(number: int) -> list[int]:
    """``number`` as sum of limb k times 2^(32 k)."""
    out = []
    for _ in range(LIMBS - 1):
        out.append(number & 0xFFFFFFFF)
        number >>= 32
    return [*out, number]


@dataclass
class Whitening:
    """What the fit list says: its number of vectors, sums, and the components with variance."""

    n: int
    size: int
    scale: int
    sums: list[int]
    directions: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Rows less the mean; the whole part of the mean is subtracted exactly."""
        mean, rest = self.mean_parts()
        # Saturated components are so far away that rounding them is of no account.
        near = np.abs(x.astype(float) - mean) < 2.0**62
        difference = np.where(near, x - np.where(near, mean, x), x.astype(float) - mean.astype(float))
        return difference.astype(float) - rest

    def mean_parts(self) -> tuple[np.ndarray, np.ndarray]:
        parts = [divmod(s, self.n) for s in self.sums]
        return np.array([q for q, _ in parts], np.int64), np.array([r / self.n for _, r in parts])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.directions / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> pa.Array:
        """The sum over dimensions of (n x - S)^2, exact; null beyond 38 digits."""
        parts = [divmod(s, self.n) for s in self.sums]
        mean, rest = np.array([q for q, _ in parts], object), np.array([r for _, r in parts], object)
        if len(x) and self.size:
            low, high = x.min(0).astype(object) - mean, x.max(0).astype(object) - mean
            most = max(self.n * (max(abs(a), abs(b)) + 1) for a, b in zip(low, high))
            if most * most * self.size < 1 << 62:
                away = self.n * (x - mean.astype(np.int64)) - rest.astype(np.int64)
                return pa.array((away * away).sum(1)).cast(pa.decimal128(38, 0))
        away = self.n * (x.astype(object) - mean) - rest
        return pa.array([int(v) if v < 10**38 else None for v in (away * away).sum(1)], pa.decimal128(38, 0))


def fit_whitening(vectors: DataFrame, components: int = 4, scale: int = 256) -> Whitening | None:
    """The whitening that ``vectors`` (embedding) give, or None where no vector can be used.

    Vectors that are null or hold null or non-finite components are left out; shorter ones count as filled up with zeros, and of
    equal ones, once they are whole numbers, there is one. What reaches the driver is a sum for each pair of dimensions.
    Components whose variance rounding can't tell from none (size times 2.2e-16 of the largest) are left out.
    """
    values = vectors.where(usable()).select(whole("embedding", scale).alias("x"))
    fit = stored(values.distinct(), "whitening-fit")
    widths = fit.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    if widths["most"] is None:
        return None
    size = widths["most"]
    if widths["least"] < size:
        zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size("x"))
        fit = stored(fit.select(F.concat("x", zeros).alias("x")).distinct(), "whitening-fit", instead_of=fit)
    near = np.array([r["x"] for r in fit.limit(SHIFT_ROWS).collect()], np.int64).reshape(-1, size)
    # Any shift gives the same scatter; the median keeps digits few.
    shift = np.sort(near, axis=0)[len(near) // 2] if size else np.zeros(0, np.int64)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scatter(shift)
        for batch in sliced(batches):
            own.add(matrix(batch.column(0), size))
        if own.rows:
            rows = np.array([limbs(v) for v in own.numbers()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), *map(pa.array, rows.T)], ["place", *[f"l{k}" for k in range(LIMBS)]])

    names = [f"l{k}" for k in range(LIMBS)]
    added = fit.mapInArrow(scatter, "place long, " + ", ".join(f"{c} long" for c in names)).groupBy("place").agg(*[F.sum(c).alias(c) for c in names])
    found = {r["place"]: sum(r[c] << (32 * k) for k, c in enumerate(names)) for r in added.collect()}
    n, sums = found[0], [found[1 + i] for i in range(size)]
    products = np.zeros((size, size), object)
    upper = np.triu_indices(size)
    products[upper] = [found[1 + size + i] for i in range(len(upper[0]))]
    exact = n * products - np.outer(np.array(sums, object), np.array(sums, object))
    covariance = np.zeros((size, size))
    covariance[upper] = [exact[i, j] / (n * n) for i, j in zip(*upper)]
    eigen, directions = np.linalg.eigh(covariance, UPLO="U") if size else (np.zeros(0), np.zeros((0, 0)))
    order = [k for k in np.argsort(-eigen, kind="stable")[:components] if eigen[k] > size * np.finfo(float).eps * eigen.max()]
    trace = sum(int(exact[i, i]) for i in range(size)) / (n * n)
    total = [s + n * int(b) for s, b in zip(sums, shift)]
    model = Whitening(n, size, scale, total, directions[:, order], eigen[order], trace)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros((1 + len(order), len(order)))
        for batch in sliced(batches):
            y = model.whitened(matrix(batch.column(0), size))
            kept[0] += y.sum(0)
            kept[1:] += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(kept.size)), pa.array(kept.ravel())], ["place", "value"])

    if order:
        rows = fit.mapInArrow(moments, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
        own = np.zeros(len(order) * (1 + len(order)))
        for r in rows:
            own[r["place"]] = r["value"]
        mean, second = own[: len(order)] / n, own[len(order):].reshape(-1, len(order)) / n
        model.identity_error = float(np.abs(second - np.outer(mean, mean) - np.eye(len(order))).max())
    return model


def whiten(vectors: DataFrame, model: Whitening | None) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component.

    ``deviation`` has up to 38 digits, null beyond. Vectors that are null or hold null or non-finite
    components are left out, as are the dimensions of longer vectors than the fit had; shorter ones count as filled up with
    zeros. Repeated rows and null ids stay; other columns are ignored. Without a model, or without any
    variance, there are no rows.
    """
    schema = f"vec_id long, component int, n long, deviation {EXACT}, whitened double, explained double, identity_error double"
    own = vectors.where(usable()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    if model is None:
        return own.where("false").selectExpr(*[f"CAST(NULL AS {f.split(' ', 1)[1]}) AS {f.split(' ', 1)[0]}" for f in schema.split(", ")])
    count = len(model.values)
    explained = model.values / model.trace if count else model.values

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            x = matrix(batch.column(1), model.size)
            row = np.repeat(np.arange(len(x)), count)
            columns = [
                batch.column(0).take(pa.array(row)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))), pa.array(np.full(len(row), model.n)),
                model.deviations(x).take(pa.array(row)), pa.array(model.whitened(x).ravel()), pa.array(np.tile(explained, len(x))),
                pa.array(np.full(len(row), model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    x = F.slice(whole("embedding", model.scale), 1, model.size) if model.size else F.array().cast("array<long>")
    return own.select("vec_id", x.alias("x")).mapInArrow(of, schema)
