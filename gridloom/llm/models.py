"""Small models fitted with NumPy on bounded samples; shared by the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a model is fitted on, about: a uniform share of the rows there are.
SAMPLE = 20_000


def held_out(key: str = "doc_id") -> Column:
    """Whether a document is in the fold that nothing is learned from; false for a null id."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(rows: DataFrame, most: int = SAMPLE) -> DataFrame:
    """About `most` rows, or all where there are fewer: those whose hashed row numbers fall below a
    share. Uniform over rows whatever their ids (none, or one for all), the same again where the
    rows lie as before, and without a sort."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), 1 << 30) < int((1 << 30) * most / n))


def weighed(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w, a row's sum being the same wherever the row lies, so that equal texts score alike to the last bit."""
    return (x * w).sum(axis=1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def adam(grad, w: np.ndarray, steps: int, rate: float = 0.05) -> np.ndarray:
    """Full-batch Adam: grad(w) is the gradient."""
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = grad(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3, steps: int = 400) -> np.ndarray:
    """Weights of a logistic regression; the last one is the intercept."""
    x1 = np.column_stack([x, np.ones(len(x))])
    s = np.ones(len(y)) if weight is None else weight
    s = s / s.sum()
    keep = np.append(np.full(x.shape[1], ridge), 0)
    return adam(lambda w: x1.T @ (s * (sigmoid(x1 @ w) - y)) + keep * w, np.zeros(x1.shape[1]), steps)
