"""Sparse one-hot rows, tiled Gram matrices and components without a p by p matrix, against numpy."""

import numpy as np
import pytest

from veiljoin.operators import models, prep, wide
from veiljoin.operators.response import flip_probability


def rows_of(spark, x):
    made = [(i, np.flatnonzero(r).tolist(), r[r != 0].tolist()) for i, r in enumerate(x)]
    return spark.createDataFrame(made, "id long, indices array<int>, values array<double>").repartition(4)


def test_one_hot_of_many_categories(spark):
    made = [(i, f"c{i % 12_000}", None if i % 5 == 0 else i % 3) for i in range(15_000)]
    rows, known, width = wide.sparse_one_hot(spark.createDataFrame(made, "id long, a string, b int"), "id", ["a", "b"])
    names = {r["index"]: (r.column, r.category) for r in known.collect()}
    assert width == 12_003 and sorted(names) == list(range(width))
    got = {r.id: sorted(names[i] for i in r.indices) for r in rows.filter("id < 200").collect()}
    assert got == {i: sorted([("a", a)] + ([("b", str(b))] if b is not None else [])) for i, a, b in made[:200]}
    with pytest.raises(ValueError):
        prep.one_hot(spark.createDataFrame(made, "id long, a string, b int"), "a")


def test_gram_tiles_are_the_gram_matrix(spark, monkeypatch):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(90, 130)) * (draw.random((90, 130)) < 0.2)
    monkeypatch.setattr(wide, "HELD_BYTES", 3 * 32 * 32 * 8)  # sums are handed on early
    for df in (wide.gram_entries(wide.gram_tiles(rows_of(spark, x), 32), 32), wide.sparse_gram(rows_of(spark, x))):
        cells, out = df.collect(), np.zeros((130, 130))
        for r in cells:
            out[r.i, r.j] = out[r.j, r.i] = r.value
        assert np.allclose(out, x.T @ x, atol=1e-9) and len(cells) == len({(r.i, r.j) for r in cells})


@pytest.mark.parametrize("centred", [False, True])
def test_components_of_ten_thousand_columns(spark, centred):
    draw = np.random.default_rng(2)
    x = np.zeros((600, 10_000))
    for i in range(600):
        group = i % 3
        x[i, draw.integers(0, 5 + 4 * group, 2) + 100 * group] = 1  # groups share few columns
        x[i, draw.integers(1000, 10_000, 3)] = 1
    c = x - x.mean(0) if centred else x
    want = np.linalg.svd(c, full_matrices=False)
    got, values = wide.principal(rows_of(spark, x), 10_000, 3, centred)
    top = want.Vh[:3]
    assert np.allclose(values, want.S[:3] ** 2, rtol=1e-6)
    assert np.abs(got - top.T @ (top @ got)).max() < 1e-5 and np.allclose(got.T @ got, np.eye(3), atol=1e-9)


def test_dense_rows_and_empty_tables(spark):
    x = np.array([[1.0, 0.0, 2.0], [0.0, 0.0, 0.0], [3.0, 4.0, 0.0]])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(9, None)], "id long, x array<double>")
    rows = wide.sparse(df, "id", "x")
    assert {r.id: (r.indices, r.values) for r in rows.collect()} == {0: ([0, 2], [1.0, 2.0]), 1: ([], []), 2: ([0, 1], [3.0, 4.0])}
    got, values = wide.principal(rows, 3, 2)
    assert np.allclose(values, np.sort(np.linalg.eigvalsh(x.T @ x))[::-1][:2])
    assert np.allclose(wide.principal(rows.limit(0), 3, 2)[1], 0) and wide.gram_tiles(rows.limit(0)).count() == 0


def test_copies_vote_through_any_fitted_model(spark):
    draw = np.random.default_rng(3)
    x = draw.choice([-1.0, 1.0], (60, 4))
    y = np.where(x[:, 0] + x[:, 1] > 0, 1.0, -1.0)
    df = spark.createDataFrame([(i, float(y[i]), x[i].tolist()) for i in range(60)], "id long, label double, x array<double>")
    asked = []

    def fitted(test):
        asked.append(test.count())
        return models.MODELS["DecisionTree"](df)(test)

    got = {r.id: r.predicted for r in models.corrected_predictions(df, "x", 2.0, fitted, 21).collect()}
    assert asked == [60 * 21]
    copies = models.noisy_copies(df, "x", 2.0, 21)
    votes = {}
    for r in models.MODELS["DecisionTree"](df)(copies).collect():
        votes.setdefault(r.id, []).append(r.predicted)
    assert got == {i: float(np.median(v)) for i, v in votes.items()} and len(got) == 60
    flips = np.mean([a != b for r in copies.join(df.selectExpr("id", "x AS whole"), "id").collect() for a, b in zip(r.x, np.maximum(r.whole, 0))])
    assert abs(flips - flip_probability(2.0)) < 0.03
    assert np.mean([got[i] == y[i] for i in range(60)]) > 0.8


@pytest.mark.parametrize("cells", [1, 3])
def test_components_of_columns_that_the_driver_does_not_hold(spark, monkeypatch, cells):
    draw = np.random.default_rng(5)
    x = np.zeros((500, 300))
    for i in range(500):
        x[i, i % 3], x[i, 3 + draw.integers(0, 4)] = 1, 1
        x[i, draw.integers(7, 300, cells)] = 1  # with several cells, columns that aren't hubs meet
    monkeypatch.setattr(wide, "DRIVER_COLUMNS", 0)
    monkeypatch.setattr(wide, "HUBS", 7)
    monkeypatch.setattr(wide, "principal", lambda *_: pytest.fail("the driver holds all columns"))
    c = x - x.mean(0)
    want = np.linalg.svd(c, full_matrices=False)
    found, values = wide.components(rows_of(spark, x), 300, 3, True, iterations=200 if cells > 1 else 60)
    got = np.zeros((300, 3))
    for r in found.collect():
        got[r["index"]] = r.lead
    assert np.allclose(values, want.S[:3] ** 2, rtol=1e-6) and np.allclose(got.T @ got, np.eye(3), atol=1e-6)
    assert np.abs(got - want.Vh[:3].T @ (want.Vh[:3] @ got)).max() < 1e-4
