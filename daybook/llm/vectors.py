"""What the two vector operators share: usable rows, pivots, packed tiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import bounded_rows


def usable(vector: str) -> Column:
    """Not null, and every component a finite number."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as doubles; shorter rows are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.zeros((len(column), dim))
    lens = np.asarray(column.value_lengths().fill_null(0))
    flat = np.asarray(column.flatten(), dtype=np.float64)
    out[np.repeat(np.arange(len(column)), lens), np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out


def sample(df: DataFrame, key: str, vector: str, dim: int, limit: int) -> np.ndarray:
    """At most ``limit`` vectors, spread by a hash of the key; for fitting pivots only."""
    got = bounded_rows(df, key, limit).select(vector).limit(2 * limit).toArrow()
    return matrix(got.column(0), dim) if got.num_rows else np.zeros((0, dim))


def pivots(points: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Centres by Lloyd's rounds, started from spread-out points; at least one."""
    if not len(points):
        return np.zeros((1, points.shape[1]))
    points = np.unique(points, axis=0)
    count = max(1, min(count, len(points)))
    chosen = [0]
    far = ((points - points[0]) ** 2).sum(1)
    while len(chosen) < count:
        at = int(far.argmax())
        chosen.append(at)
        far = np.minimum(far, ((points - points[at]) ** 2).sum(1))
    centres = points[chosen].astype(np.float64)
    for _ in range(rounds):
        near = nearest(points, centres)[0]
        for c in range(count):
            if (near == c).any():
                centres[c] = points[near == c].mean(0)
    return centres


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (points**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * points @ centres.T
    return np.sqrt(np.maximum(square, 0))


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = distances(points, centres)
    at = d.argmin(1)
    return at, d[np.arange(len(points)), at]
