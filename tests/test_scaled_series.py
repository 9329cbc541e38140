"""Work on long series by bounded pieces: the same numbers for any cut."""

import time
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from millrace import ordered
from millrace.operators import arima, changepoints as CP, forecast as FC, panel as PN, timeseries as T


def test_arima_blocks_run_in_pieces():
    rng, theta = np.random.default_rng(1), np.array([0.4, -0.3])
    x = rng.normal(size=(2, 501))
    v = np.zeros((2, 503))
    for t in range(501):
        v[:, t + 2] = x[:, t] - theta[0] * v[:, t + 1] - theta[1] * v[:, t]
    assert np.allclose(arima.recursed(x, theta), v[:, 2:])
    y, n = rng.normal(size=100_000).cumsum(), 100_000
    start = time.process_time()
    arima.block_map(y, np.arange(n), np.arange(n) > 2, np.array([0.1, 0.2, 0.1, 0.3]), 2, 1, 1)
    assert time.process_time() - start < 1.5  # row by row it took 3 to 4 seconds


def test_smoothing_blocks_run_in_pieces(monkeypatch):
    y, got = np.random.default_rng(2).normal(size=203), {}
    for rows in (3, 1000):
        monkeypatch.setattr(FC, "PIECE_ROWS", rows)
        got[rows] = [FC.block_maps(y, FC.weights_around(None, 0.1, t, p), t, p, 2 if p else 0) for t, p in ((False, 0), (True, 0), (True, 7))]
    assert all(np.allclose(a, b) for a, b in zip(got[3], got[1000]))


def test_lagged_products_need_no_table_of_lags():
    y, lags, n = np.random.default_rng(3).normal(size=20_000).cumsum(), 60, 20_000
    home, pos, d = np.ones(n, bool), np.arange(n), np.diff(y, prepend=np.nan)
    at = pos[lags + 1:]
    table = np.column_stack([d[at], np.ones(len(at)), y[at - 1], *[d[at - k] for k in range(1, lags + 1)]])
    tracemalloc.start()
    got = T.lagged_gram(y, home, pos, lags)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got, np.append((table.T @ table).ravel(), len(at))) and peak < table.nbytes / 5


def _walks(spark):
    rng = np.random.default_rng(4)
    rows = [(None if s == "b" else s, i, float(v)) for s in "abc" for i, v in enumerate(rng.normal(size=400).cumsum())]
    return spark.createDataFrame(rows, "s string, i int, v double")


def test_tests_by_series_in_small_blocks(spark, monkeypatch):
    df, numbers = _walks(spark), ("adf_statistic", "kpss_statistic")
    take = lambda: sorted((r["s"] or "", *[r[c] for c in numbers]) for r in PN.stationarity(df, "v", ["i"], ["s"]).collect())
    acf = lambda: sorted((r["s"] or "", r["lag"], r["acf"]) for r in PN.autocorrelation(df, "v", ["i"], ["s"], 5).collect())
    whole, seen, plain = (take(), acf()), [], ordered.blocked
    monkeypatch.setattr(T, "BLOCK_ROWS", 60)
    monkeypatch.setattr(ordered, "blocked", lambda *a, **k: seen.append(k["rows"]) or plain(*a, **k))
    cut = take(), acf()
    assert seen and set(seen) == {60}
    for a, b in zip(whole, cut):
        assert [r[0] for r in a] == [r[0] for r in b] and np.allclose([r[1:] for r in a], [r[1:] for r in b])


def test_segments_search_edges_once(spark, monkeypatch):
    df, calls, plain = _walks(spark), [], ordered.with_bucket
    marks = df.select("s", F.explode(F.expr("array(100L, 250L)")).alias("position")).distinct()
    take = lambda: sorted((r["s"] or "", r["segment"], r["start"], r["end"], round(r["mean"], 9), r["samples"])
                          for r in CP.segments(df, "v", ["i"], marks, ["s"]).collect())
    expected = take()
    monkeypatch.setattr(ordered, "is_small", lambda *a: False)
    monkeypatch.setattr(ordered, "SMALL_GROUP", 70)
    monkeypatch.setattr(ordered, "with_bucket", lambda *a, **k: calls.append(1) or plain(*a, **k))
    assert take() == expected and len(expected) == 9 and len(calls) == 1
