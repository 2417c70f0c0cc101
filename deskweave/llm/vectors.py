"""Reading vectors in tasks, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: str) -> Column:
    """Not null, not empty, all components finite, at least one not zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    vector = F.col(column).cast("array<double>")
    good = F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & good, F.lit(False))


def lengths(vectors: DataFrame, column: str) -> list[int]:
    """The different lengths of vectors, smallest first; only equally long ones can be compared."""
    return sorted(r["d"] for r in vectors.groupBy(F.size(column).alias("d")).count().collect())


def length_of(column: str) -> Column:
    """Euclidean length, by way of the largest component so that no square overflows or vanishes."""
    vector = F.col(column).cast("array<double>")
    most = F.array_max(F.transform(vector, F.abs))
    return most * F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + (x / most) * (x / most)))


def scaled(rows: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component to one half or more: exact, and safe to square."""
    exponent = np.frexp(np.abs(rows).max(axis=1, initial=0))[1]
    # In two steps, as one factor could itself be too large.
    half = -exponent // 2
    return np.ldexp(np.ldexp(rows, half[:, None]), (-exponent - half)[:, None])


def units(rows: np.ndarray) -> np.ndarray:
    rows = scaled(rows)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of equally long vectors in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def packed(rows: np.ndarray) -> bytes:
    return np.ascontiguousarray(rows, np.float64).tobytes()


def unpacked(value: pa.Scalar, width: int) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.float64).reshape(-1, width)
