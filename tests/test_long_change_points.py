"""Change points of series beyond the former block sizes: against one search with all pairs."""

import numpy as np
import pandas as pd
import pytest

from millrace.operators import changepoints as CP


def dense_rbf(y):
    d = (y[:, None] - y) ** 2
    k = np.exp(-np.clip(d / (np.median(d[np.triu_indices(len(y), 1)]) or 1.0), 1e-2, 1e2))
    return lambda a, b: np.array([k.diagonal()[i:b].sum() - k[i:b, i:b].sum() / (b - i) for i in a])


@pytest.mark.parametrize("model, n", [("rbf", 1600), ("l1", 2100)])
def test_long_series_are_searched_whole(spark, model, n):
    rng = np.random.default_rng(n)
    y = rng.normal(0, 0.1, n).cumsum() * 0.2 + rng.normal(0, 0.1, n)
    df = spark.createDataFrame(pd.DataFrame({"t": np.arange(n), "y": y}))
    cost = dense_rbf(y) if model == "rbf" else CP.segment_cost(y, model)
    want = CP.best_partition([*range(0, n, 5), n], cost, y.std(), 10)
    got = sorted(r["position"] for r in CP.change_points(df, "y", ["t"], model=model, penalty_factor=1.0).collect())
    assert got == want and want


def test_a_long_series_leaves_others_alone(spark):
    rng = np.random.default_rng(8)
    short, long = rng.normal(0, 0.1, 1200).cumsum() * 0.2 + rng.normal(0, 0.1, 1200), rng.normal(0, 5, 1600)
    frame = pd.DataFrame({"s": ["a"] * 1200 + ["b"] * 1600, "t": [*range(1200), *range(1600)], "y": [*short, *long]})
    df = spark.createDataFrame(frame)
    pick = lambda d: sorted(r["position"] for r in CP.change_points(d, "y", ["t"], ["s"], "rbf", penalty_factor=1.0).where("s = 'a'").collect())
    assert pick(df) == pick(df.where("s = 'a'")) == CP.best_partition([*range(0, 1200, 5), 1200], dense_rbf(short), short.std(), 10)


@pytest.mark.parametrize("limit", [10, 1_000_000])
def test_bandwidth_is_the_median_of_all_pairs(monkeypatch, limit):
    monkeypatch.setattr(CP, "GAPS", limit)
    rng = np.random.default_rng(1)
    for y in (rng.normal(size=2), rng.normal(size=51), rng.normal(size=200), rng.integers(0, 3, 80).astype(float), np.zeros(60), np.repeat([0.0, 7.0], 30)):
        assert CP.middle_square(y) == pytest.approx(np.median(((y[:, None] - y) ** 2)[np.triu_indices(len(y), 1)]), rel=1e-9)
