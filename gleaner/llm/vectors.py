"""Whole-number vectors: what centroid clustering and vector codes share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole components below this in size keep squared distances of a few hundred components within a long.
LIMIT = 1 << 27


def is_finite(vector: str) -> Column:
    """Whether an array is there and holds finite numbers alone."""
    return F.coalesce(F.col(vector).isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False))), F.lit(False))


def whole(vectors: pa.ListArray, scale: int, width: int) -> np.ndarray:
    """floor(scale * x) of each component, one row a vector; all vectors have `width` components."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    scaled = np.floor(flat * scale).reshape(len(vectors), width)
    if scaled.size and np.abs(scaled).max() >= LIMIT:
        raise ArithmeticError(f"a component of {np.abs(flat).max()} is too large: distances would leave a long")
    return scaled.astype(np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to the rows of c beside them (or to one row)."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def nearest_two(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of x the nearest centre (ties: the lower index), its squared distance and that of the nearest other centre (-1 if there is none)."""
    best, at, second = squared(x, centres[0]), np.zeros(len(x), np.int64), np.full(len(x), -1)
    for k in range(1, len(centres)):
        d = squared(x, centres[k])
        closer = d < best
        other = np.where(closer, best, d)
        second = np.where((second < 0) | (other < second), other, second)
        best, at = np.where(closer, d, best), np.where(closer, k, at)
    return at, best, second


def floor_means(old: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """floor(sum / count) by component for every row that has members; rows without stay as they are."""
    return np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], old)


def joined(numbers) -> str:
    return ",".join(map(str, np.asarray(numbers).ravel().tolist()))
