"""Vector expressions and the numpy kernels behind Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vec: Column, dim: int | None = None) -> Column:
    """True if the vector can be compared: not null, no NaN or infinity, not all zero."""
    fine = F.coalesce(
        F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists(vec, lambda x: x != 0),
        F.lit(False),
    )
    return fine & (F.size(vec) == dim) if dim else fine


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalise(vec: Column) -> Column:
    """Unit length; the norm is clipped at 1e-9, so an all-zero vector stays zero."""
    n = F.greatest(norm(vec), F.lit(1e-9))
    return F.transform(vec, lambda x: x.cast("double") / n)


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def matrix(column: pa.ChunkedArray | pa.Array, dtype=np.float32) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix, without a Python loop."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(arr)
    flat = np.asarray(arr.flatten(), dtype=dtype)
    return flat.reshape(n, -1) if n else np.zeros((0, 0), dtype)


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of unit length."""
    return m / np.maximum(np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True), 1e-9).astype(m.dtype)


def lists(m: np.ndarray) -> pa.Array:
    """A float matrix as an Arrow list column."""
    n, d = m.shape
    offsets = np.arange(0, (n + 1) * d, d, dtype=np.int32) if d else np.zeros(n + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(m).reshape(-1), type=pa.float32()))
