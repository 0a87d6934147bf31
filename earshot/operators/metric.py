"""Pivots of vectors, for bounds by the triangle inequality."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_vectors(df: DataFrame, key: str, vec: str, most: int) -> np.ndarray:
    """(rows, dims) doubles of at most `most` rows, those with the least hashes of their key; null vectors are left out."""
    rows = df.filter(F.col(vec).isNotNull()).select(F.col(key).alias("_k"), F.col(vec).alias("_v")).orderBy(F.xxhash64("_k"), "_k").limit(most).collect()
    return np.array([r["_v"] for r in rows], np.float64) if rows else np.zeros((0, 0))


def farthest(points: np.ndarray, n: int) -> np.ndarray:
    """Up to n of the points: the first one, then always the one farthest from all so far (until all others are copies)."""
    if not len(points):
        return points
    picked, gap = [0], ((points - points[0]) ** 2).sum(axis=1)
    while len(picked) < n and gap.max() > 0:
        picked.append(int(gap.argmax()))
        gap = np.minimum(gap, ((points - points[picked[-1]]) ** 2).sum(axis=1))
    return points[picked]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(rows of a, rows of b) Euclidean distances."""
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0))
