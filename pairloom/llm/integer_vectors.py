"""Vectors as whole numbers: what the operators on exact sums share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Exact sums in Spark: 38 decimal digits.
EXACT = "decimal(38,0)"


def usable(vector: str = "embedding") -> Column:
    """Whether a vector is there and holds neither nulls nor non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(F.col(vector).isNotNull() & fine, F.lit(False))


def whole(vector: str, scale: int) -> Column:
    """floor(scale * x) of each component as a long; what lies beyond a long becomes the nearest one."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def matrix(lists: pa.Array, size: int) -> np.ndarray:
    """Lists of longs as rows of ``size``; shorter ones are filled with zeros."""
    values, ends = np.asarray(lists.flatten()).astype(np.int64), np.cumsum(np.asarray(pc.list_value_length(lists)), dtype=np.int64)
    if len(values) == size * len(lists) and np.array_equal(ends, size * np.arange(1, len(lists) + 1)):
        return values.reshape(len(lists), size)
    out = np.zeros((len(lists), size), np.int64)
    lengths = np.diff(ends, prepend=0)
    row = np.repeat(np.arange(len(lists)), lengths)
    out[row, np.arange(len(values)) - np.repeat(ends - lengths, lengths)] = values
    return out
