"""Least squares without intercept, with corrections for rows that the noise invents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moments(df: DataFrame, features: list[str], label: str | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """X'X, X'y and the row count in one aggregate; only p by p numbers leave the cluster."""
    p = len(features)
    cells = {f"x{i}_{j}": F.sum(F.col(features[i]) * F.col(features[j])) for i in range(p) for j in range(i, p)}
    if label:
        cells |= {f"y{i}": F.sum(F.col(features[i]) * F.col(label)) for i in range(p)}
    row = df.agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in cells.items()]).first()
    xx = np.array([[row[f"x{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(p)] for i in range(p)])
    xy = np.array([row[f"y{i}"] or 0.0 for i in range(p)]) if label else np.zeros(p)
    return xx, xy, row["n"]


def ols(df: DataFrame, features: list[str], label: str) -> np.ndarray:
    xx, xy, _ = moments(df, features, label)
    return np.linalg.lstsq(xx, xy, rcond=None)[0]


def join_size(kept: int, known: int, h: float) -> float:
    """The size of the true join: (m - hN) / (1 - 2h)."""
    return (kept - h * known) / (1 - 2 * h)


def oblivious(df: DataFrame, features: list[str], label: str, known: int, h: float) -> np.ndarray:
    """X'X scaled to the share of rows that aren't invented, as if invented rows looked like all others."""
    xx, xy, m = moments(df, features, label)
    return np.linalg.solve(xx * ((m - h * (known - join_size(m, known, h))) / m), xy)


def data_dependent(df: DataFrame, features: list[str], label: str, known: DataFrame, h: float) -> np.ndarray:
    """X'X less what invented rows add, known from all known rows' features."""
    xx, xy, _ = moments(df, features, label)
    ff, _, _ = moments(known, features)
    return np.linalg.solve((xx - h * ff) * ((1 - h) / (1 - 2 * h)), xy)


def noisy_features(df: DataFrame, features: list[str], label: str, count: float, sens: float, eps: float) -> np.ndarray:
    """X'X less the variance 2 (sens / eps)^2 that Laplace noise adds to each of ``count`` rows."""
    xx, xy, _ = moments(df, features, label)
    return np.linalg.solve(xx - count * 2 * (sens / eps) ** 2 * np.eye(len(features)), xy)


def predict(features: list[str], beta: np.ndarray) -> Column:
    return sum((F.col(f) * F.lit(float(b)) for f, b in zip(features, beta)), F.lit(0.0))


def mse(df: DataFrame, predicted: Column, label: str) -> DataFrame:
    return df.agg(F.avg(F.pow(predicted - F.col(label), F.lit(2.0))).alias("mse"))


def accuracy(df: DataFrame, predicted: Column, label: str) -> DataFrame:
    return df.agg(F.avg((predicted == F.col(label)).cast("double")).alias("accuracy"))
