"""One-column detectors by blocks: the same scores for any cut, without joins by neighbour or searched edges."""

import numpy as np

from millrace import ordered
from millrace.operators import detectors as D, multivariate as MV, neighbours


def _line(spark, n=300, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(np.concatenate([rng.normal(size=n - 3), [9.0, 9.5, -20.0]]), 2)  # some values are repeated
    return x, spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "k long, x double")


def _scores(df):
    return np.array([r["score"] for r in df.orderBy("k").collect()])


def test_loci_counts_by_blocks(spark, monkeypatch):
    x, df = _line(spark)
    monkeypatch.setattr(ordered, "fill_along", None)
    monkeypatch.setattr(MV, "LOCI_BLOCK", 7, raising=False)
    monkeypatch.setattr(MV, "LOCI_PART", 2, raising=False)
    got, expected, gap = _scores(MV.loci(df, ["k"])), np.zeros(len(x)), x[None, :] - x[:, None]
    for r in MV.LOCI_RADII:
        r *= x.max() - x.min()
        own = ((x[None, :] >= (x - r / 2)[:, None]) & (x[None, :] <= (x + r / 2)[:, None])).sum(1)
        for i in range(len(x)):
            near = own[(x >= x[i] - r) & (x <= x[i] + r)]
            if len(near) >= MV.LOCI_LEAST and near.std() > 1e-4:
                expected[i] = max(expected[i], (near.mean() - own[i]) / near.std())
    assert gap.shape == (len(x), len(x)) and np.allclose(got, expected, atol=1e-8)


def test_sos_of_one_column_needs_no_join_of_neighbours(spark, monkeypatch):
    _, df = _line(spark)
    flat = df.selectExpr("*", "0D AS zero")
    expected = _scores(MV.sos(flat, ["k"], ["x", "zero"]))  # the same distances by the general way
    monkeypatch.setattr(neighbours, "others", None)
    monkeypatch.setattr(MV, "SOS_BLOCK", 40, raising=False)
    assert np.allclose(_scores(MV.sos(df, ["k"], ["x"])), expected, rtol=1e-9)


def test_sos_of_one_row_and_of_gaps(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None)], "k long, x double")
    assert [r["score"] for r in MV.sos(df, ["k"], ["x"]).orderBy("k").collect()] == [1.0, None]


def test_lmdd_cuts_its_orders_by_hash(spark, monkeypatch):
    _, df = _line(spark)
    expected = _scores(MV.lmdd(df, ["k"], ["x"]))
    monkeypatch.setattr(ordered, "with_bucket", None)
    monkeypatch.setattr(ordered, "is_small", lambda *a: False)
    monkeypatch.setattr(ordered, "SMALL_GROUP", 50)
    assert np.allclose(_scores(MV.lmdd(df, ["k"], ["x"])), expected, rtol=1e-9)


def test_knn_by_blocks_without_window_rows(spark, monkeypatch):
    x, df = _line(spark)
    monkeypatch.setattr(ordered, "framed", None)
    monkeypatch.setattr(D, "BLOCK_ROWS", 11)
    away = np.sort(np.abs(x[:, None] - x[None, :]), 1)[:, D.KNN_K]
    assert np.allclose(_scores(D.knn(df, ["k"])), away, atol=1e-12)
    assert D.knn(df.limit(1), ["k"]).first()["score"] is None
