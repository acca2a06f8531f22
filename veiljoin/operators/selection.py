"""Private feature selection."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.randomness import uniform
from .features import ROOT2, gram


def square_root(matrix: np.ndarray) -> np.ndarray:
    """Of a symmetric matrix; small negative eigenvalues count as 0."""
    values, vectors = np.linalg.eigh(matrix)
    return (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T


def draw_block(block: int, size: int, root: np.ndarray, rows: int, eps: float | None, seed: int) -> np.ndarray:
    """How often each column of the root is nearest to one of ``size`` directions of length sqrt(rows), noise added to the distances."""
    draw = np.random.Generator(np.random.PCG64([seed, block]))
    r = draw.standard_normal((size, len(root)))
    r *= math.sqrt(rows) / np.linalg.norm(r, axis=1, keepdims=True)
    distance = np.sqrt(np.maximum(2 * rows - 2 * r @ root, 0))
    if eps is not None:
        distance += draw.laplace(scale=ROOT2 * len(root) / eps, size=distance.shape)
    return np.bincount(distance.argmin(axis=1), minlength=len(root))


def feature_distribution(
    df: DataFrame, vector: str, eps: float | None, seed: int, samples_per_row: int = 100, block: int = 10_000,
) -> list[float]:
    """How often each column of the Gram matrix's root is nearest to a random direction, each counted once more.

    Columns are taken to have the length sqrt(rows), as columns of signs have, so a direction r of that length is
    sqrt(2 rows - 2 r.c) away from column c. The Gram matrix is one distributed aggregate; directions are drawn
    by tasks, a block of them at a time, and only their counts by column are gathered.
    """
    root = square_root(gram(df, vector))
    rows = df.filter(F.col(vector).isNotNull()).count()
    total = samples_per_row * rows
    if not total:
        return [1 / len(root)] * len(root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch["id"].tolist():
                counts = draw_block(b, min(block, total - b * block), root, rows, eps, seed)
                yield pd.DataFrame({"i": range(len(counts)), "n": counts})

    blocks = df.sparkSession.range(-(-total // block))
    counts = np.ones(len(root))
    for r in blocks.mapInPandas(run, "i int, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect():
        counts[r.i] += r.n
    return (counts / counts.sum()).tolist()


def top_columns(p: list[float], k: int) -> list[int]:
    """The k likeliest columns, for all rows the same."""
    return sorted(sorted(range(len(p)), key=lambda i: (-p[i], i))[:k])


def row_mask(id: Column, total: int, k: int, seed: int, p: list[float] | None = None) -> Column:
    """0/1 for each column: k of them a row, without replacement, uniform or by weights p."""
    keys = F.array(*[
        F.struct(
            (uniform(id, "mask", seed, i) if p is None else -F.ln(uniform(id, "mask", seed, i)) / F.lit(float(p[i]))).alias("key"), F.lit(i).alias("i")
        )
        for i in range(total)
    ])
    chosen = F.transform(F.slice(F.array_sort(keys), 1, k), lambda x: x.i)
    return F.transform(F.sequence(F.lit(0), F.lit(total - 1)), lambda i: F.when(F.array_contains(chosen, i), 1.0).otherwise(0.0))
