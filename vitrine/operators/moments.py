"""Principal components from mergeable co-moments.

One aggregate gives the means and the covariances of all pairs of columns (partial results merge, so any
partitioning will do); what comes after is arithmetic on a matrix of a row per column. Covariances, means and
loadings are rounded, so that neither the order of summation nor the engine decides a digit.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up

COVARIANCE_DIGITS = 6
MEAN_DIGITS = 9
LOADING_DIGITS = 9
#: Squarings of the matrix: its power is then 2**SQUARINGS, which leaves one direction of any that differ.
SQUARINGS = 40


def co_moments(df: DataFrame, cols: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(means, sample covariances) of the columns in one pass."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    means = [round_half_up(F.avg(c), MEAN_DIGITS) for c in cols]
    shared = [round_half_up(F.covar_samp(F.col(cols[i]).cast("double"), F.col(cols[j]).cast("double")), COVARIANCE_DIGITS) for i, j in pairs]
    row = df.agg(F.array(*means).alias("means"), F.array(*shared).alias("shared")).first()
    out = np.zeros((len(cols), len(cols)))
    for (i, j), v in zip(pairs, row.shared):
        out[i, j] = out[j, i] = v or 0.0
    return np.array([m or 0.0 for m in row.means]), out


def leading(matrix: np.ndarray) -> tuple[float, np.ndarray]:
    """(eigenvalue, unit eigenvector) of the largest eigenvalue of a symmetric matrix, by repeated squaring. The
    largest loading, the first of equal ones, is positive. A matrix of zeros has no direction: the first axis."""
    power = matrix
    for _ in range(SQUARINGS):
        size = float((power * power).sum()) ** 0.5
        if size == 0:
            return 0.0, np.eye(len(matrix))[0]
        power = (power / size) @ (power / size)
    column = power[:, int(np.argmax(np.diag(power)))]
    vector = column / float((column * column).sum()) ** 0.5
    vector = vector * np.sign(vector[int(np.argmax(np.abs(vector)))])
    return float(vector @ matrix @ vector), vector


def principal_components(df: DataFrame, cols: list[str], n: int = 2) -> tuple[np.ndarray, list[np.ndarray], list[float], float]:
    """(means, loadings of the first ``n`` components, their variances, total variance)."""
    means, rest = co_moments(df, cols)
    total, loadings, variances = float(np.trace(rest)), [], []
    for _ in range(n):
        value, vector = leading(rest)
        rest = rest - value * np.outer(vector, vector)
        loadings.append(np.floor(vector * 10**LOADING_DIGITS + 0.5) / 10**LOADING_DIGITS)
        variances.append(value)
    return means, loadings, variances, total


def projected(cols: list[str], means: np.ndarray, loading: np.ndarray) -> Column:
    """Coordinate on a component: the terms are added in the order of the columns."""
    out = None
    for c, m, w in zip(cols, means.tolist(), loading.tolist()):
        term = (F.col(c).cast("double") - F.lit(m)) * F.lit(w)
        out = term if out is None else out + term
    return out
