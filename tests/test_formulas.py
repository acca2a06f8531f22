"""Feature distribution, private PCA, exact quantiles, bandwidths and grids against plain numpy forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veiljoin.operators import bandwidth, features, models, prep, selection
from veiljoin.plans import experiments, sweep


def table(spark, x):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, x array<double>")


def test_feature_distribution(spark):
    draw = np.random.default_rng(3)
    base = np.sign(draw.standard_normal((150, 1)))
    x = np.hstack([base, base, base * np.sign(draw.random((150, 1)) - 0.1), np.sign(draw.standard_normal((150, 3)))])
    root = selection.square_root(x.T @ x)
    assert np.allclose(root @ root, x.T @ x)
    r = draw.standard_normal((60_000, 6))
    r *= math.sqrt(150) / np.linalg.norm(r, axis=1, keepdims=True)
    far = np.sqrt(2 * 150 - 2 * r @ root) + draw.laplace(scale=math.sqrt(2) * 6 / 5.0, size=(60_000, 6))
    want = np.bincount(far.argmin(axis=1), minlength=6) / 60_000
    got = selection.feature_distribution(table(spark, x), "x", 5.0, 1, samples_per_row=400)
    assert np.allclose(got, want, atol=0.01) and np.ptp(got) > 0.05
    assert selection.feature_distribution(table(spark, x), "x", 5.0, 1, block=777) != got


def test_private_pca_by_the_formulas(spark):
    x = np.random.default_rng(0).standard_normal((400, 4)) * [4, 2, 1, 0.5] + [1, 0, 0, 2]
    df = table(spark, x)
    s = np.abs(x).max(axis=0) + 0.001
    y = (x / (2 * s) + 1) / 2
    draw = np.random.Generator(np.random.PCG64(5))
    z = y - (y.mean(axis=0) + draw.laplace(scale=2 / (400 * 3.0), size=4))
    noise = np.tril(draw.laplace(scale=6 * 16 / (400 * 3.0), size=(4, 4)))
    u = np.linalg.svd(z.T @ z / 400 + noise + noise.T)[0][:, :2]
    basis = features.private_pca_laplace(df, "x", 2, 3.0, 5)
    assert np.allclose(basis.vectors @ basis.vectors.T, u @ u.T, atol=1e-8)
    raw = df.select(basis.raw()(F.col("x")).alias("y")).orderBy("id" if "id" in df.columns else "y").limit(1)
    assert len(raw.first().y) == 2
    draw = np.random.Generator(np.random.PCG64(5))
    v = np.linalg.qr(draw.standard_normal((4, 2)))[0]
    sigma = math.sqrt(4 * 2 * 3 * math.log(1e4)) / 50.0
    for _ in range(3):
        v = np.linalg.qr(x.T @ x @ v + draw.normal(scale=(np.abs(v).max() * sigma) ** 2, size=(4, 2)))[0]
    got = features.private_pca_power(df, "x", 2, 50.0, 3, None, 5).vectors
    assert np.allclose(got @ got.T, v @ v.T, atol=1e-8)


def test_exact_quantiles(spark):
    draw = np.random.default_rng(1)
    groups = {0: draw.lognormal(0, 6, 3000), 1: np.repeat([1.0, 2.0], 500), 2: np.array([7.0]), 3: np.array([-1e300, 0.0, 1e-300, 1e300, 5.0])}
    values = spark.createDataFrame([(i, float(v)) for i, vs in groups.items() for v in vs] + [(0, None), (1, math.nan)], "i int, v double")
    got = features.exact_quantiles(values, [0.05, 0.5, 0.95, 1.0], bins=16)
    for i, vs in groups.items():
        assert np.allclose(got[i], np.quantile(vs, [0.05, 0.5, 0.95, 1.0]), rtol=1e-9)
    assert features.exact_quantiles(values.limit(0), [0.5]) == {}


def test_bandwidths(spark):
    x = np.random.default_rng(2).standard_normal((70, 3))
    pairs = [np.linalg.norm(x[i] - x[j]) for i in range(70) for j in range(i)]
    assert math.isclose(bandwidth.median_of_all(table(spark, x), "id", "x").first()[0], np.median(pairs))
    blocks = bandwidth.all_distances(table(spark, x).withColumns({"i": F.lit(0), "n": F.lit(1)}), "i", 70, block_rows=9)
    assert np.allclose(sorted(r.v for r in blocks.collect()), sorted(pairs))
    assert bandwidth.median_of_all(table(spark, x[:1]), "id", "x").first()[0] is None
    places = {r.place for r in prep.numbered(table(spark, x), "id", 7).collect()}
    assert places == set(range(70))


@pytest.mark.parametrize("bernoulli", [True, False])
def test_naive_bayes_by_trial(spark, bernoulli):
    draw = np.random.default_rng(4)
    rows = [(t, int(y), (draw.standard_normal(2) + 0.7 * y * (t + 1)).tolist()) for t in (0, 1) for y in draw.choice([-1, 1], 150)]
    rows += [(2, 1, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "trial int, label int, x array<double>")
    test = [(int(y), (draw.standard_normal(2) + y).tolist()) for y in draw.choice([-1, 1], 90)]
    got = {r.trial: r.value for r in models.naive_bayes_accuracy(df, spark.createDataFrame(test, "label int, x array<double>"), 2, bernoulli).collect()}
    for t in (0, 1):
        by = {y: np.array([x for k, label, x in rows if k == t and label == y]) for y in (-1, 1)}

        def score(y, x):
            a, x = by[y], np.array(x)
            if bernoulli:
                rate = ((a > 0).sum(axis=0) + 1) / (len(a) + 2)
                return math.log(len(a)) + np.log(np.where(x > 0, rate, 1 - rate)).sum()
            v = a.var(axis=0) + 1e-9
            return math.log(len(a)) - (np.log(v) / 2 + (x - a.mean(axis=0)) ** 2 / (2 * v)).sum()

        assert math.isclose(got[t], np.mean([(1 if score(1, x) > score(-1, x) else -1) == y for y, x in test]))
    assert got[2] is None


def test_failed_trials_are_null(spark):
    found = sweep.run_grid(spark, [{"a": k, "trial": t} for k in (1, 2) for t in range(3)], lambda a, trial: spark.createDataFrame([(t, 0.5) for t in trial if t != a], "trial int, value double"))
    assert {(r.a, r.trial): r.value for r in found.collect()} == {(k, t): None if t == k else 0.5 for k in (1, 2) for t in range(3)}
    one = experiments.Split(*[spark.createDataFrame([(1, 1, [1.0])], "id long, label int, x array<double>").select(*c) for c in (("id", "label"), ("id", "x"), ("id", "label", "x"))])
    assert one.control("GaussianNB") is None


def test_votes_without_a_shuffle(spark):
    df = spark.createDataFrame([(i, [1.0, -1.0]) for i in range(5)], "id long, x array<double>")
    out = models.corrected_votes(df, "x", 1.0, lambda x: features.dot(x, F.array(F.lit(1.0), F.lit(1.0))), 7)
    assert "Exchange" not in out._jdf.queryExecution().toString() and out.count() == 5
