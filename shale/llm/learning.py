"""What the trained operators share: folds, the labelled sample, logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % parts


def held_out(doc_id: str | Column, parts: int, which: int) -> Column:
    return F.coalesce(fold(doc_id, parts) == which, F.lit(False))


def sampled(labels: DataFrame, key: str, most: int) -> DataFrame:
    """About `most` rows, chosen by a hash of the key; all rows if there are no more."""
    n = labels.count()
    if n <= most:
        return labels
    return labels.where(F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1 << 20)) < int((1 << 20) * most / n))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Weights (the last one constant) by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        g = x.T @ (y - p) - ridge * w
        h = (x * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))
