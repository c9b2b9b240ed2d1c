"""Vectors as exact integers: floor(scale * x) of every component."""
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LONG = (1 << 63) - 1


def finite(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                               & (F.abs(x.cast("double")) != float("inf"))), F.lit(False))


def floors(values: np.ndarray, scale: int, limit: float) -> np.ndarray:
    """floor(scale * values), a scale being a power of two: 64-bit integers where all are below ``limit`` in size, else
    Python's integers, which are exact at any size."""
    scaled = np.floor(values * scale) if np.abs(values).max(initial=0) < limit / scale else None
    if scaled is not None:
        return scaled.astype(np.int64)
    found = np.empty(values.shape, object)
    found.ravel()[:] = [floor(x * scale) if abs(x) < 2.0**53 else int(x) * scale for x in values.ravel().tolist()]
    return found


def as_long(value: int) -> int:
    """The value as a long; what lies beyond counts as the largest or smallest."""
    return max(-LONG - 1, min(LONG, int(value)))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one size as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def by_size(batch: pa.RecordBatch, column: str) -> list[tuple[int, np.ndarray]]:
    """(size, rows that have it) for each vector size of a batch, smallest first."""
    sizes = batch.column(column).value_lengths().to_numpy(zero_copy_only=False)
    return [(int(size), np.flatnonzero(sizes == size)) for size in np.unique(sizes)]
