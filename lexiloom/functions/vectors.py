"""Vector functions: expressions for plans that must stay declarative, Arrow functions where the arithmetic is the work."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def usable(v: Column, dim: int) -> Column:
    """Of the right length, finite, without nulls and not all zero; false for null."""
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dim) & ok & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(v: Column, least: float = 1e-10) -> Column:
    """Scaled to length one; a zero vector stays."""
    d = v.cast("array<double>")
    n = norm(v)
    return F.when(n > least, F.transform(d, lambda x: x / n)).otherwise(d)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as float64; null or odd rows aren't allowed here, so filter by ``usable`` first."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty((0, 0))
    return np.asarray(column.flatten().cast(pa.float64())).reshape(len(column), -1)


def list_column(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, d or 1)[: n + 1], pa.int32()), pa.array(np.ascontiguousarray(x).ravel(), kind))


def unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)
