"""Neighbours and median distances with pruning: the same as over all pairs, from far fewer."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veiljoin.operators import bandwidth, cells, models, prep

ROWS = "id long, label double, x array<double>"


def clustered(seed, n, groups=40, width=4):
    draw = np.random.default_rng(seed)
    centres = draw.uniform(-100, 100, (groups, width))
    x = centres[draw.integers(0, groups, n)] + draw.normal(size=(n, width))
    return x.round(3), np.where(draw.random(n) < 0.5, 1.0, -1.0)


def table(spark, x, y):
    return spark.createDataFrame([(i, float(y[i]), x[i].tolist()) for i in range(len(x))], ROWS).repartition(4)


def test_neighbours_are_those_of_all_pairs_and_few_are_compared(spark):
    x, y = clustered(1, 3000)
    z, _ = clustered(2, 200)
    z[:50] = x[:50]  # ties at 0, and queries near the groups
    z[50:100] = x[50:100] + 0.001
    test = table(spark, z, np.ones(200))
    got, compared = cells.pruned_neighbours(table(spark, x, y), test, 5, block_rows=64)
    near = {r.id: [(n.d, n.n_id) for n in r.ns] for r in got.collect()}
    for i in range(200):
        gaps = ((x - z[i]) ** 2).sum(1).round(9)
        order = sorted(range(3000), key=lambda j: (gaps[j], j))[:5]
        assert [n for _, n in near[i]] == order and np.allclose([d for d, _ in near[i]], gaps[order])
    assert compared < 200 * 3000 / 5


def test_votes_equal_those_of_all_pairs(spark):
    draw = np.random.default_rng(3)
    x, y = draw.integers(0, 4, (300, 3)).astype(float), np.where(draw.random(300) < 0.5, 1.0, -1.0)  # many ties
    train, test = table(spark, x, y), table(spark, draw.integers(0, 4, (60, 3)).astype(float), np.ones(60))
    votes = lambda df: sorted((r.id, r.predicted) for r in df.collect())
    assert votes(cells.pruned_votes(train, test)) == votes(models.nearest_votes(train, test))
    few = train.filter("id < 3")
    assert votes(cells.pruned_votes(few, test)) == votes(models.nearest_votes(few, test))
    assert {r.predicted for r in cells.pruned_votes(train.limit(0), test).collect()} == {None}


def test_one_crowded_pivot_is_many_blocks(spark):
    x = np.zeros((2000, 2))
    x[:100] = np.arange(200).reshape(100, 2)
    held = cells.cells(table(spark, x, np.ones(2000)), pivots=3, block_rows=50)
    assert held.count.sum() == 2000 and held.count.max() < 120 and sorted(held.pivot) == held.pivot.tolist()
    got, _ = cells.pruned_neighbours(table(spark, x, np.ones(2000)), table(spark, np.zeros((2, 2)), np.ones(2)), 4, 3, 50)
    assert [[n.n_id for n in r.ns] for r in got.collect()] == [[100, 101, 102, 103]] * 2


@pytest.mark.parametrize("kind", ["clustered", "ties", "plain"])
def test_median_distance_is_exact_and_prunes(spark, kind):
    x = {"clustered": clustered(5, 1200)[0], "ties": np.random.default_rng(1).integers(0, 3, (400, 2)).astype(float), "plain": np.random.default_rng(2).normal(size=(301, 3))}[kind]
    df = table(spark, x, np.ones(len(x)))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))[np.triu_indices(len(x), 1)]
    got, evaluated = cells.median_by_cells(df, "id", "x", block_rows=32, few=300)
    assert got == pytest.approx(np.median(d), rel=1e-12)
    if kind == "clustered":
        assert evaluated < len(d) / 2
    if kind != "clustered":
        assert got == pytest.approx(bandwidth.median_of_all(df, "id", "x").first().bandwidth, rel=1e-12)


def test_median_of_few_rows(spark):
    df = table(spark, np.array([[0.0], [3.0], [3.0]]), np.ones(3))
    assert cells.median_by_cells(df.limit(0), "id", "x") == (None, 0) and cells.median_by_cells(df.filter("id = 0"), "id", "x")[0] is None
    assert cells.median_by_cells(df.filter("id < 2"), "id", "x")[0] == 3 and cells.median_by_cells(df.filter("id > 0"), "id", "x")[0] == 0


def test_samples_meet_their_cut_without_a_product(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = spark.range(5000).withColumn("g", F.col("id") % 3)
        one = prep.subsample(df, "id", 0.25, 3)
        many = prep.keep_ranked(df, "id", 3, spark.createDataFrame([(0, 10), (1, 5), (2, 0)], "g long, k long"), "g")
        for out in (one, many):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan and "SortMergeJoin" not in plan
        assert one.count() == 1250 and {r.g: r["count"] for r in many.groupBy("g").count().collect()} == {0: 10, 1: 5}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_without_clusters_meet_in_large_blocks(spark, monkeypatch):
    draw = np.random.default_rng(4)
    x, y, z = draw.normal(size=(500, 12)).round(2), np.where(draw.random(500) < 0.5, 1.0, -1.0), draw.normal(size=(40, 12)).round(2)
    seen = []
    monkeypatch.setattr(cells, "meet", lambda held, asked, k, parts, f=cells.meet: seen.append(asked.count()) or f(held, asked, k, parts))
    got, compared = cells.pruned_neighbours(table(spark, x, y), table(spark, z, np.ones(40)), 5, block_rows=16)
    want = [sorted(range(500), key=lambda j, v=v: (((x[j] - v) ** 2).sum().round(9), j))[:5] for v in z]
    assert {r.id: [n.n_id for n in r.ns] for r in got.collect()} == dict(enumerate(want))
    assert compared == 500 * 40 and len(seen) == 1 and seen[0] < 1000  # rows aren't copied for each block
