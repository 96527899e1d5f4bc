"""Means and covariances from sums that Spark gathers group by group."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moment_columns(v: str, p: int, where: Column | None = None) -> list[Column]:
    """n, the sums of v[i] and of v[i]*v[j], i <= j, over the rows that meet ``where``."""
    x = [F.col(v)[i] if where is None else F.when(where, F.col(v)[i]) for i in range(p)]
    n = F.count(F.lit(1)) if where is None else F.count(F.when(where, 1))
    pairs = [F.sum(x[i] * F.col(v)[j]) for i in range(p) for j in range(i, p)]
    return [n.alias("n"), F.array(*[F.sum(c) for c in x]).alias("s1"), F.array(*pairs).alias("s2")]


def estimate(n: float, s1, s2) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance (divided by n) of one row of moment_columns."""
    p = len(s1)
    mean = np.asarray(s1, float) / n
    second = np.zeros((p, p))
    second[np.triu_indices(p)] = np.asarray(s2, float) / n
    second = np.triu(second) + np.triu(second, 1).T
    return mean, second - np.outer(mean, mean)


def gather(df: DataFrame, group: str, v: str, p: int, where: Column | None = None) -> DataFrame:
    return df.groupBy(group).agg(*moment_columns(v, p, where))


def chi2_cdf(x: float, p: int) -> float:
    """Of the chi-squared distribution with an even number p of degrees of freedom."""
    term = total = 1.0
    for i in range(1, p // 2):
        term *= x / 2 / i
        total += term
    return 1 - float(np.exp(-x / 2)) * total


def chi2_quantile(q: float, p: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, p) < q else (low, mid)
    return high


def factor(cov: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Inverse of the Cholesky factor of the covariance with floor**2 added to its diagonal."""
    return np.linalg.inv(np.linalg.cholesky(cov + np.diag(floor**2)))
