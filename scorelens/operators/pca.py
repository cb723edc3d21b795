"""Principal components of sparse vectors without a slots x slots matrix.

Block subspace iteration: a thin matrix, one column per component and a few
more, is multiplied by the covariance again and again. Each multiplication is
one pass over the rows: tasks project their rows, take the column means out and
add up what goes back to each slot. The driver holds slots x columns numbers
and turns them into orthonormal columns.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.functions.vectors import nonzero_slots
from scorelens.operators.packed import packed, slot_moments, sums_by_slot

TOLERANCE, MOST = 1e-5, 60
EXTRA = 10
SEED = 11
# What the driver and every task may hold: 2^26 doubles are half a gigabyte.
LARGEST = 2**26


def times_covariance(records: DataFrame, q: np.ndarray, mean: np.ndarray, rows: int) -> np.ndarray:
    """The covariance of packed rows times a thin matrix."""
    width, columns = q.shape
    sent = records.sparkSession.sparkContext.broadcast((np.asfortranarray(q), mean @ q))

    def add(total, label, slot, value, row):
        q, offset = sent.value
        for j in range(columns):
            y = np.bincount(row, value * q[:, j][slot], len(label)) - offset[j]
            total[:, j] += np.bincount(slot, value * y[row], width)

    found = sums_by_slot(records, width, columns, add) / (rows - 1)
    sent.destroy()
    return found


def principal_components(
    df: DataFrame, vector: str, width: int, k: int, tolerance: float = TOLERANCE, most: int = MOST
) -> tuple[np.ndarray, np.ndarray]:
    """(width x k loadings, share of the variance of each component), largest first.

    Passes go on until the covariance turns each of the k components no further
    away from itself than `tolerance` times the largest eigenvalue, or `most`
    passes are done; eigenvalues are then off by about the square of that. Each
    component's largest loading is positive. Needs two rows at least.
    """
    columns = min(width, k + EXTRA)
    if width * columns > LARGEST:
        raise ValueError(f"{width} slots x {columns} columns are more than the driver should hold")
    records = packed(df, F.lit(0.0), nonzero_slots(vector), "pca-entries")
    rows, moments = slot_moments(records, width)
    if rows < 2:
        raise ValueError("principal components need two rows")
    s, squares, _ = moments.T
    mean = s / rows
    variance = float((squares - s * s / rows).sum() / (rows - 1))
    q = np.linalg.qr(np.random.default_rng(SEED).normal(size=(width, columns)))[0]
    for _ in range(most):
        turned = times_covariance(records, q, mean, rows)
        small = q.T @ turned
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        loadings = q @ turn[:, :k]
        away = np.linalg.norm(turned @ turn[:, :k] - loadings * values[:k], axis=0)
        if away.max(initial=0.0) <= tolerance * max(values[0], 0.0):
            break
        q = np.linalg.qr(turned)[0]
    loadings *= np.where(loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])] < 0, -1, 1)
    shares = values[:k] / variance if variance > 0 else np.zeros(min(k, columns))
    return loadings, shares
