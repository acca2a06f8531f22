"""The median of all distances by counting, against brute force: overlapping blocks, ties, copies, far-off and odd cells."""

import numpy as np
import pytest

from veiljoin.operators import bandwidth

DRAW = np.random.default_rng(11)
CASES = {
    "plain": DRAW.normal(size=(300, 5)),
    "even": DRAW.normal(size=(301, 2)),
    "ties": DRAW.integers(0, 2, (200, 3)).astype(float),
    "copies": np.repeat(DRAW.normal(size=(4, 3)), 50, axis=0),
    "equal": np.ones((40, 3)),
    "far": 1e6 + DRAW.normal(size=(150, 4)),
    "two groups": np.r_[DRAW.normal(size=(150, 2)), 1e3 + DRAW.normal(size=(150, 2))],
    "three": np.array([[0.0], [1.0], [5.0]]),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_median_is_that_of_all_pairs(spark, name, monkeypatch):
    x = CASES[name]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, x array<double>").repartition(3)
    want = np.median(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))[np.triu_indices(len(x), 1)])
    monkeypatch.setattr(bandwidth, "all_distances", lambda *_: pytest.fail("distances are listed"))
    got = bandwidth.median_of_all(df, "id", "x", bins=64, few=50, block_rows=37).first().bandwidth
    assert got == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_rows_without_finite_cells_are_left_out(spark):
    rows = [(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [float("nan"), 0.0]), (4, None), (5, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    assert bandwidth.median_of_all(df, "id", "x").first().bandwidth == pytest.approx(5.0)
    assert bandwidth.median_of_all(df.filter("id = 1"), "id", "x").first().bandwidth is None and bandwidth.median_of_all(df.limit(0), "id", "x").first().bandwidth is None
