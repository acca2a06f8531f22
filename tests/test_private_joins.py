"""Limits, distributions and algebra of the private joins; every query against its SQL on the smallest tables."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from veiljoin.functions import randomness as rnd
from veiljoin.functions.budget import Budget, BudgetError
from veiljoin.operators import features, join, models, prep, regression, response, sketch
from veiljoin.plans.queries import QUERIES, SQL
from veiljoin.sources.tables import read_csv, read_results, with_id, write_csv

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return float(f"{v:.8g}") if isinstance(v, float) else [plain(x) for x in v] if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = db.sql(SQL[name])
    order = [d[0] for d in want.description]
    assert sorted(order) == sorted(got.columns)
    key = lambda r: str(r)
    a = sorted(([plain(r[c]) for c in order] for r in got.collect()), key=key)
    b = sorted(([plain(x) for x in r] for r in want.fetchall()), key=key)
    assert a == b


#: Queries whose parts others run too.
SLOW = {"model_accuracies", "sweep_sign_columns", "sweep_pca_iterations", "sweep_bandwidths"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_other_queries_have_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_nearest_votes_in_many_blocks(spark):
    draw = np.random.Generator(np.random.PCG64(1))
    x, y = draw.integers(0, 4, (200, 3)).astype(float), draw.integers(0, 4, (30, 3)).astype(float)
    label = np.where(x[:, 0] + draw.normal(size=200) > 1.5, 1.0, -1.0)
    train = spark.createDataFrame([(i, float(label[i]), x[i].tolist()) for i in range(200)], "id long, label double, x array<double>")
    test = spark.createDataFrame([(i, y[i].tolist()) for i in range(30)], "id long, x array<double>")
    got = {r.id: r.predicted for r in models.nearest_votes(train, test, 5, train_rows=20, test_rows=7, fan_in=3).collect()}
    near = [sorted(range(200), key=lambda i, v=v: (((x[i] - v) ** 2).sum(), i))[:5] for v in y]
    assert got == {j: 1.0 if label[n].sum() >= 0 else -1.0 for j, n in enumerate(near)}


def test_sign_encoding(spark):
    row = spark.range(1).select(response.encode_signs(F.array(*map(F.lit, (-1.0, 0.0, 1.0)))).alias("x")).first()
    assert row.x == [0.0, 0.5, 1.0]


def test_infinite_budget_is_the_inner_join(spark):
    known = spark.createDataFrame([(1, 1.0), (2, -1.0), (3, 1.0)], "id long, l double")
    private = spark.createDataFrame([(1, 2.0), (3, -1.0)], "id long, f double")
    out = join.join_values(known, private, "id", ["f"], eps_memb=math.inf, eps_val=1e12, sens=1.0, seed=1)
    assert sorted((r.id, round(r.f, 6)) for r in out.collect()) == [(1, 2.0), (3, -1.0)]


def test_empty_buckets_have_noise_and_collisions_add(spark):
    one = spark.createDataFrame([(5, 1.0)], "id long, f double")
    noisy = sketch.value_sketch(one, "id", "f", 1.0, 1.0, 16, 3).collect()
    assert len(noisy) == 16 and all(r.value != 0 for r in noisy)
    many = spark.range(8).withColumn("f", F.lit(1.0))
    exact = sketch.member_sketch(many, "id", math.inf, 2, 3).agg(F.sum("value")).first()[0]
    signs = many.agg(F.sum(rnd.sign(F.col("id"), "memb", 3))).first()[0]
    assert exact == signs


def test_distributions(spark):
    ids = spark.range(40_000)
    p = math.exp(-1)
    row = ids.agg(
        F.avg((rnd.geometric(F.col("id"), "t", 1, 1.0) == 0).cast("int")).alias("zero"), F.avg(F.abs(rnd.laplace(F.col("id"), "t", 1, 3.0))).alias("abs"),
        F.stddev(rnd.gaussian(F.col("id"), "t", 1)).alias("sd"),
    ).first()
    assert abs(row.zero - (1 - p) / (1 + p)) < 0.01 and abs(row["abs"] - 3) < 0.1 and abs(row.sd - 1) < 0.02


def test_flip_and_clip(spark):
    df = spark.createDataFrame([(1, 1.0, -2.0), (2, 1.0, 0.0)], "id long, l double, membership double")
    assert [r.l for r in join.flip_labels(df, "l").collect()] == [-1.0]
    x = spark.createDataFrame([([3.0, -3.0, 0.1],)], "x array<double>").select(features.clip(F.col("x")).alias("x")).first().x
    assert np.allclose(x, [math.sqrt(2), -math.sqrt(2), 0.1])


def test_corrections_without_noise_are_least_squares(spark):
    df = spark.range(1, 50).select((F.col("id") / 10).alias("x")).withColumn("y", 2 * F.col("x"))
    assert np.allclose([regression.ols(df, ["x"], "y")[0], regression.oblivious(df, ["x"], "y", 49, 0.0)[0], regression.data_dependent(df, ["x"], "y", df, 0.0)[0]], 2)


def test_pca_spans_the_top_space(spark):
    draw = np.random.default_rng(0)
    x = draw.standard_normal((200, 5)) * [5, 3, 1, 0.5, 0.1]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, x array<double>")
    top = np.linalg.eigh(x.T @ x)[1][:, -2:]
    for basis in (features.pca(df, "x", 2), features.private_pca_power(df, "x", 2, None, 60, 1.0, 1)):
        v = basis.vectors
        assert np.allclose(v @ v.T, top @ top.T, atol=1e-5) and np.allclose(v.T @ v, np.eye(2))


def test_budget():
    b = Budget(3.0)
    assert b.split(1, ("memb", "pca")) == {"memb": 1.0, "pca": 1.0, "value": 1.0}
    with pytest.raises(BudgetError):
        b.spend("more", 0.1)


def test_exact_sample_and_sources(spark, tmp_path):
    df = spark.range(1000)
    assert prep.subsample(df, "id", 0.3, 1).distinct().count() == 300
    assert sorted(r.n for r in with_id(spark.range(20).toDF("v").repartition(3), "n").collect()) == list(range(20))
    write_csv(spark.createDataFrame([(5, 0.5, 0.1, 0.2)], "`Dimension` int, `A` double, `A 25` double, `A 75` double"), str(tmp_path / "r"))
    r = read_results(spark, str(tmp_path / "r"), "Dimension").first()
    assert (r.series, r.low, r.high) == ("A", 0.4, 0.7)
    assert read_csv(spark, str(tmp_path / "r"), "Dimension").columns[0] == "id"


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.startswith("sweep_") and n not in SQL))
def test_sweeps_report_25_trials(spark, monkeypatch, name):
    from veiljoin.plans import sweep

    def fake(spark, grid, trial):
        return spark.createDataFrame([s | {"value": float(s["trial"])} for s in grid])

    monkeypatch.setattr(sweep, "run_grid", fake)
    out = QUERIES[name](spark, SF).collect()
    assert out and all(r.low == r.high > 0 for r in out)
    for r in out:
        middle = r.ratio if name == "sweep_regression" else r.median
        assert middle == pytest.approx(2 * r.low) and (name == "sweep_regression" or r.median == 12)


@pytest.mark.parametrize("name", ["pca_gram", "pca_centred", "private_pca_laplace", "private_pca_power"])
def test_pca_queries_take_all_cells(spark, name):
    assert QUERIES[name](spark, SF).count() == 64


def test_sweeps_and_models_take_all_cells(spark, monkeypatch):
    from veiljoin.plans import experiments, queries

    split, cells = queries.vector_split(spark, SF), []
    assert {len(r.x) for t in (split.private, split.test) for r in t.collect()} == {64}
    monkeypatch.setattr(experiments, "fourier_trial", lambda split, n, *_, **s: cells.append(n) or 0.0)
    monkeypatch.setattr(experiments, "open_trial", lambda split, n, *_, **s: cells.append(n) or 0.0)
    for name in ("sweep_fourier", "sweep_bandwidths", "sweep_without_privacy"):
        QUERIES[name](spark, SF).collect()
    assert set(cells) == {64}
