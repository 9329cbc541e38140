"""Conditional least squares over blocks: against the recursion over a whole series."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from millrace.operators import arima, timeseries as T


def errors(y, beta, p, d, q):
    w = np.diff(y, d) if d else np.asarray(y, float)
    e = np.zeros(len(w))
    for t in range(p, len(w)):
        e[t] = w[t] - beta[0] - sum(beta[i] * w[t - i] for i in range(1, p + 1)) - sum(beta[p + j] * e[t - j] for j in range(1, q + 1) if t - j >= 0)
    return e[p:]


def simulated(n, seed, theta=0.5):
    rng, y, w, e = random.Random(seed), [20.0], 0.0, 0.0
    for _ in range(n - 1):
        new = rng.gauss(0, 1)
        w, e = 0.1 + 0.6 * w + new + theta * e, new
        y.append(y[-1] + w)
    return y


@pytest.mark.parametrize("p, d, q", [(2, 0, 0), (0, 1, 1), (1, 1, 1), (2, 1, 2)])
def test_fit_over_blocks(spark, monkeypatch, p, d, q):
    tables = {"a": simulated(160, 1), None: simulated(90, 2, -0.3)}
    rows = [(s, i, v, i % 3) for s, y in tables.items() for i, v in enumerate(y)] + [("a", 1000, None, 0), ("short", 0, 1.0, 0)]
    df = spark.createDataFrame(rows, "s string, t int, y double, _b int")
    got = []
    for size in (50_000, 23):
        monkeypatch.setattr(arima, "BLOCK_ROWS", size)
        _, _, fits = arima.fitted_errors(df.drop("_b"), "y", ["t"], p, d, q, ["s"])
        got.append({r["s"]: (r["_best"], r["_sse"]) for r in fits.collect()})
    for s, y in tables.items():
        best, sse = got[1][s]
        assert best == pytest.approx(got[0][s][0], abs=1e-4) and sse == pytest.approx(got[0][s][1], rel=1e-8)
        assert sse == pytest.approx((errors(y, best, p, d, q) ** 2).sum(), rel=1e-9)
        for j in range(len(best)):
            for move in (-1e-3, 1e-3):
                other = [b + move * (i == j) for i, b in enumerate(best)]
                assert (errors(y, other, p, d, q) ** 2).sum() >= sse * (1 - 1e-9)
    out = {(r["s"], r["t"]): r["fitted"] for r in T.arima_fit(df, "y", ["t"], p, d, q, ["s"]).collect()}
    assert len(out) == len(rows) and out["a", 1000] is None and out["short", 0] is None
    for s, y in tables.items():
        e = errors(y, got[1][s][0], p, d, q)
        assert all(out[s, i] is None for i in range(p + d))
        assert [out[s, i] for i in range(p + d, len(y))] == pytest.approx([v - x for v, x in zip(y[p + d:], e)], rel=1e-9)


def test_the_weights_of_a_simulated_series(spark):
    df = spark.createDataFrame(pd.DataFrame({"t": range(3000), "y": simulated(3000, 3)}))
    _, _, fits = arima.fitted_errors(df, "y", ["t"], 1, 1, 1)
    best = fits.first()["_best"]
    assert best[1] == pytest.approx(0.6, abs=0.06) and best[2] == pytest.approx(0.5, abs=0.06) and math.isfinite(best[0])
