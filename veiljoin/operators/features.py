"""Feature creation: Gram matrix, random Fourier features, projections, PCA, sensitivities, quantiles."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.budget import BudgetError, Ledger
from ..functions.randomness import gaussian_value, uniform_value

ROOT2 = math.sqrt(2)


def doubles(values: np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def gram_cells(df: DataFrame, vector: str) -> DataFrame:
    """i, j, value: the sum of outer products. Each task sends one p by p matrix, whatever its rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            x = np.array(batch["x"].dropna().tolist(), dtype=float)
            if len(x):
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "value": total.ravel()})

    parts = df.select(F.col(vector).cast("array<double>").alias("x")).mapInPandas(run, "i int, j int, value double")
    return parts.groupBy("i", "j").agg(F.sum("value").alias("value"))


def gram(df: DataFrame, vector: str, limit: int = 4096) -> np.ndarray:
    """The Gram matrix on the driver; refused beyond ``limit`` columns."""
    size = df.agg(F.max(F.size(vector)).alias("p")).first().p or 0
    if size > limit:
        raise ValueError(f"{size} columns are more than {limit}")
    cells = gram_cells(df, vector).toPandas()
    out = np.zeros((size, size))
    out[cells["i"], cells["j"]] = cells["value"]
    return out


@dataclass
class Fourier:
    """Random Fourier features: sqrt(2) cos(x omega + beta)."""

    omega: np.ndarray
    beta: np.ndarray

    @classmethod
    def draw(cls, p: int, d: int, bandwidth: float = 1.0, power: int = 1, seed: int = 7) -> Fourier:
        """Frequencies sqrt(2) N(0, 1) / bandwidth**power, phases uniform on [0, 2 pi)."""
        omega = np.array([[ROOT2 * gaussian_value(i, "omega", seed, j) / bandwidth**power for j in range(d)] for i in range(p)])
        return cls(omega, np.array([2 * math.pi * uniform_value(j, "beta", seed) for j in range(d)]))

    def __call__(self, x: Column) -> Column:
        return F.array(*[
            F.lit(ROOT2) * F.cos(dot(x, doubles(self.omega[:, j])) + F.lit(float(self.beta[j]))) for j in range(len(self.beta))
        ])


def projection_matrix(p: int, d: int, seed: int = 7) -> np.ndarray:
    """Johnson-Lindenstrauss: N(0, 1), unscaled."""
    return np.array([[gaussian_value(i, "jl", seed, j) for j in range(d)] for i in range(p)])


def project(x: Column, matrix: np.ndarray) -> Column:
    return F.array(*[dot(x, doubles(matrix[:, j])) for j in range(matrix.shape[1])])


def round_binary(x: Column, id: Column, seed: int, low: float = -ROOT2, high: float = ROOT2) -> Column:
    """Each cell at random to high or low, with its own value (for values within sqrt(2)) as expectation."""
    from ..functions.randomness import uniform

    return F.transform(x, lambda v, i: F.when(uniform(id, "round", seed, i) > 0.5 * (1 - v / ROOT2), F.lit(high)).otherwise(F.lit(low)))


def clip(x: Column, bound: float = ROOT2) -> Column:
    return F.transform(x, lambda v: F.greatest(F.least(v, F.lit(bound)), F.lit(-bound)))


def flatten_scale(x: Column, scale: float = 255.0) -> Column:
    """A nested array as one flat array of floats, divided by ``scale``."""
    return F.transform(F.flatten(x), lambda v: (v / scale).cast("float"))


def cells(df: DataFrame, vector: str) -> DataFrame:
    return df.select(F.posexplode(vector).alias("i", "v")).select("i", F.col("v").cast("double").alias("v"))


def sensitivities(df: DataFrame, vector: str, centred: bool = False) -> DataFrame:
    """i, sens: the largest absolute value of each column, or of its distance from the mean.

    max |v - mean| is the larger of max - mean and mean - min, so one pass does.
    """
    own = F.greatest(F.max("v") - F.avg("v"), F.avg("v") - F.min("v")) if centred else F.max(F.abs("v"))
    return cells(df, vector).groupBy("i").agg(own.alias("sens"))


def exact_quantiles(values: DataFrame, quantiles: list[float], bins: int = 1024) -> dict[int, list[float]]:
    """Exact quantiles, interpolated between neighbours, of ``v`` by the integer ``i``, of which there are a bounded number; a column ``n`` counts copies.

    No task holds a group's values. An interval is kept around each order statistic that is asked for; each round
    counts what lies in the bins of all intervals in one aggregate and goes on with the bins that hold the statistics,
    until a bin holds one value. Null, NaN and infinite values are left out.
    """
    copies = F.sum("n") if "n" in values.columns else F.count(F.lit(1))
    values = values.filter("abs(v) < double('Infinity')")
    stats = {r.i: r for r in values.groupBy("i").agg(copies.alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()}
    ranks = {(i, q): q * (r.n - 1) for i, r in stats.items() for q in quantiles}
    #: (i, rank) to the interval that holds it and the number of values below that
    held = {(i, k): (stats[i].low, stats[i].high, 0) for (i, _), x in ranks.items() for k in (math.floor(x), math.ceil(x))}
    while wide := [(i, k, *map(float, v[:2])) for (i, k), v in held.items() if v[0] < v[1]]:
        table = values.sparkSession.createDataFrame(wide, "i int, k bigint, low double, high double")
        at = F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))
        found = values.join(F.broadcast(table), "i").filter("v >= low and v <= high").groupBy("i", "k", at.alias("bin"))
        rows = found.agg(copies.alias("n"), F.min("v").alias("least"), F.max("v").alias("most")).orderBy("i", "k", "bin").collect()
        below = {(i, k): held[i, k][2] for i, k, _, _ in wide}
        for r in rows:
            key = (r.i, r.k)
            if below[key] <= r.k < below[key] + r.n:
                held[key] = (r.least, r.most, below[key])
            below[key] += r.n
    out = {}
    for i in stats:
        pairs = [(held[i, math.floor(ranks[i, q])][0], held[i, math.ceil(ranks[i, q])][0], ranks[i, q] % 1) for q in quantiles]
        out[i] = [a + (b - a) * f if a != b else a for a, b, f in pairs]
    return out


def quantile_report(df: DataFrame, vector: str) -> DataFrame:
    """i, top, q95, q05, low of each column."""
    found = exact_quantiles(cells(df, vector), [1.0, 0.95, 0.05, 0.0])
    return df.sparkSession.createDataFrame([(i, *map(float, q)) for i, q in found.items()], "i int, top double, q95 double, q05 double, low double")


@dataclass
class Basis:
    """A PCA basis with the scaling of the data that it was fitted on."""

    vectors: np.ndarray
    scale: np.ndarray
    shift: np.ndarray

    def __call__(self, x: Column) -> Column:
        y = F.zip_with(F.zip_with(x, doubles(self.scale), lambda v, s: v / s), doubles(self.shift), lambda v, m: v - m)
        return project(y, self.vectors)

    def raw(self) -> Basis:
        """The same vectors for rows that aren't scaled."""
        return Basis(self.vectors, np.ones_like(self.scale), np.zeros_like(self.shift))


def leading(matrix: np.ndarray, d: int) -> np.ndarray:
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    return vectors[:, np.argsort(-np.abs(values))[:d]]


def pca(df: DataFrame, vector: str, d: int, centred: bool = False) -> Basis:
    """Leading eigenvectors of the Gram matrix, or of the covariance if ``centred``."""
    g = gram(df, vector)
    p = g.shape[0]
    means = np.zeros(p)
    if centred:
        means, n = column_means(df, vector, p)
        g = g - n * np.outer(means, means)
    return Basis(leading(g, d), np.ones(p), means)


def column_means(df: DataFrame, vector: str, p: int) -> tuple[np.ndarray, int]:
    rows = cells(df, vector).groupBy("i").agg(F.avg("v").alias("m"), F.count(F.lit(1)).alias("n")).collect()
    means = np.zeros(p)
    for r in rows:
        means[r.i] = r.m
    return means, max((r.n for r in rows), default=0)


@dataclass
class Moments:
    """A table's Gram matrix, means, largest absolute values and row count: all that a PCA needs of it."""

    gram: np.ndarray
    means: np.ndarray
    largest: np.ndarray
    rows: int

    @classmethod
    def of(cls, df: DataFrame, vector: str) -> Moments:
        g = gram(df, vector)
        p = g.shape[0]
        means, n = column_means(df, vector, p)
        largest = np.zeros(p)
        for r in sensitivities(df, vector).collect():
            largest[r.i] = r.sens
        return cls(g, means, largest, n)


def charged(ledger: Ledger | None, df: DataFrame | Moments, eps: float | None) -> None:
    """Charge a basis to the table's sources; moments don't tell theirs, so they can't be charged."""
    if ledger and isinstance(df, Moments):
        raise BudgetError("a ledger needs the private table, not its moments")
    if ledger and not isinstance(df, Moments):
        ledger.charge(df, "basis", math.inf if eps is None else eps)


def private_pca_laplace(
    df: DataFrame | Moments, vector: str, d: int, eps: float | None, seed: int, bounds: np.ndarray | None = None, spread: float = 4.0,
    ledger: Ledger | None = None,
) -> Basis:
    """PCA of data scaled to x / (spread * s) + 1/2, with Laplace noise on means and covariance.

    ``s`` are public ``bounds`` of |x|, or else the data's own, which aren't private, and 0.001 more. With a
    spread of 4 scaled data lie in [1/4, 3/4], with 2 they fill [0, 1], so that the same noise weighs a quarter. Noise is
    added to p numbers and a symmetric p by p matrix. The basis serves scaled rows; ``Basis.raw`` gives one
    for rows as they are. Without eps it is the Gram matrix's basis, with neither scaling nor noise.
    """
    charged(ledger, df, eps)
    m = df if isinstance(df, Moments) else Moments.of(df, vector)
    g, means, n, p = m.gram, m.means, m.rows, len(m.means)
    if eps is None:
        return Basis(leading(g, d), np.ones(p), np.zeros(p))
    scale = spread * ((m.largest if bounds is None else np.asarray(bounds, float)) + 0.001)
    draw = np.random.Generator(np.random.PCG64(seed))
    mid = means / scale + 0.5
    second = g / np.outer(scale, scale) / n + 0.5 * (means / scale)[:, None] + 0.5 * (means / scale)[None, :] + 0.25
    noisy = mid + draw.laplace(scale=2 / (n * eps), size=p)
    cov = second - np.outer(mid, noisy) - np.outer(noisy, mid) + np.outer(noisy, noisy)
    noise = np.tril(draw.laplace(scale=6 * p * p / (n * eps), size=(p, p)))
    return Basis(leading(cov + noise + noise.T, d), scale, noisy - 0.5)


def private_pca_power(
    df: DataFrame | Moments, vector: str, d: int, eps: float | None, iterations: int, bound: float | None, seed: int, delta: float = 1e-4, variance_as_scale: bool = True,
    ledger: Ledger | None = None,
) -> Basis:
    """PCA by the power method with Gaussian noise in each iteration; one distributed aggregate.

    In each iteration the noise's sigma is multiplied by the largest absolute cell of the current vectors, or by ``bound`` if
    that is given. The product is squared for the standard deviation, or taken as it is without ``variance_as_scale``.
    """
    charged(ledger, df, eps)
    g = df.gram if isinstance(df, Moments) else gram(df, vector)
    p = g.shape[0]
    draw = np.random.Generator(np.random.PCG64(seed))
    x = np.linalg.qr(draw.standard_normal((p, d)))[0]
    sigma = math.sqrt(4 * d * iterations * math.log(1 / delta)) / eps if eps else 0.0
    for _ in range(iterations):
        std = (np.abs(x).max() if bound is None else bound) * sigma
        y = g @ x + (draw.normal(scale=std**2 if variance_as_scale else std, size=(p, d)) if std else 0)
        x = np.linalg.qr(y)[0]
    return Basis(x, np.ones(p), np.zeros(p))
