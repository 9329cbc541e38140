"""Expressions that look along an order, on the plain and the split path, against a data frame library."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions.expressions import column_expr
from millrace.operators import columns as C

TEXTS = {
    "v.shift(2)": lambda v: v.shift(2), "v.shift(-3)": lambda v: v.shift(-3), "v.diff()": lambda v: v.diff(), "v.diff(-2)": lambda v: v.diff(-2),
    "v.shift(1, fill_value=9)": lambda v: v.shift(1, fill_value=9), "v.cumsum()": lambda v: v.cumsum(), "v.cummax()": lambda v: v.cummax(),
    "v.cummin() + 1": lambda v: v.cummin() + 1, "v.ffill()": lambda v: v.ffill(), "v.bfill()": lambda v: v.bfill(),
    "v.rolling(4).sum()": lambda v: v.rolling(4).sum(), "v.rolling(5, min_periods=2).max()": lambda v: v.rolling(5, min_periods=2).max(),
    "v.rolling(3, center=True).mean()": lambda v: v.rolling(3, center=True).mean(), "v.rolling(4).count()": lambda v: v.rolling(4).count(),
    "v.rolling(4, min_periods=2).std()": lambda v: v.rolling(4, min_periods=2).std(),
    "v.expanding().sum()": lambda v: v.expanding().sum(), "v.expanding().mean()": lambda v: v.expanding().mean(),
    "v.expanding().max()": lambda v: v.expanding().max(), "v.expanding(min_periods=7).min()": lambda v: v.expanding(7).min(),
    "v.expanding(5).mean()": lambda v: v.expanding(5).mean(), "v.rolling(4, min_periods=2).count()": lambda v: v.rolling(4, min_periods=2).count(),
    "v.expanding().count()": lambda v: v.expanding().count(),
    "v.rank()": lambda v: v.rank(), "v.rank(method='min', ascending=False)": lambda v: v.rank(method="min", ascending=False),
    "v.rank(method='dense', ascending=False)": lambda v: v.rank(method="dense", ascending=False), "v.rank('max', pct=True)": lambda v: v.rank(method="max", pct=True),
    "v.rank(method='dense', pct=True)": lambda v: v.rank(method="dense", pct=True),
    "v.diff().cumsum()": lambda v: v.diff().cumsum(), "v.ffill().diff().rolling(3).mean()": lambda v: v.ffill().diff().rolling(3).mean(),
    "v.shift(1).rank() - v.rank().shift(1)": lambda v: v.shift(1).rank() - v.rank().shift(1),
}


def data(names):
    rng = random.Random(3)
    rows = [(s, i, None if rng.random() < 0.15 else float(rng.randint(-6, 6))) for s in names for i in range(150)]
    return rows + [(names[0], 200 + i, None) for i in range(90)] + [(names[0], 300 + i, float(i % 4)) for i in range(30)]


def check(spark, rows, series):
    df = spark.createDataFrame(rows, "g string, i int, v double").repartition(5, "i")
    texts = {f"t{n}": t for n, t in enumerate(TEXTS)}
    got = C.add_many_computed(df, texts, ["i"], series)
    assert got.columns == ["g", "i", "v", *texts]
    got = got.orderBy("g", "i").toPandas()
    frame = pd.DataFrame(rows, columns=["g", "i", "v"]).sort_values(["g", "i"], na_position="first").reset_index(drop=True)
    assert len(got) == len(frame)
    for (name, text), want in zip(texts.items(), TEXTS.values()):
        parts = frame.groupby("g", dropna=False, sort=False)["v"] if series else [(None, frame["v"])]
        wanted = pd.concat([want(v) for _, v in parts]).sort_index()
        pd.testing.assert_series_equal(got[name].astype(float), wanted.astype(float), check_names=False, obj=text)


def test_one_series(spark):
    check(spark, data(["a"]), [])


def test_many_series_with_a_null_one(spark):
    check(spark, data(["a", None, "c"]), ["g"])


def test_split_path_one_series(spark, split_always):
    check(spark, data(["a"]), [])


def test_split_path_many_series(spark, split_always):
    check(spark, data(["a", None, "c"]), ["g"])


def test_edges(spark):
    df = spark.createDataFrame([(1, 5, "x", 1.0), (2, 3, "y", float("nan")), (3, 8, None, 2.0)], "`row id` int, n int, s string, _along0_x double")
    value = lambda text: [r["new"] for r in C.add_computed(df, "new", text, order_by=["row id"]).orderBy("row id").collect()]
    assert value("n.cumsum()") == [5, 8, 16] and value("n.cummax()") == [5, 5, 8]
    assert value("s.shift(1)") == [None, "x", "y"] and value("s.ffill()") == ["x", "y", "y"]
    assert value("_along0_x.cumsum()") == [1.0, None, 3.0]
    assert value("n - n.diff().mean()") == [3.5, 1.5, 6.5]
    assert value("`row id`.shift(-1) == 3") == [False, True, None]
    assert value("n.str.len()") == [1, 1, 1]
    assert C.keep_rows(df, "n.diff() > 0", order_by=["row id"]).select("row id").collect() == [(3,)]
    assert C.delete_rows(df, "n.diff() > 0", order_by=["row id"]).count() == 2  # unknown stays
    assert C.add_computed(df.limit(0), "new", "n.rank() + n.cumsum()", order_by=["row id"]).count() == 0
    for bad in ("n.shift(1, 2, 3)", "n.rank(method='first')", "n.rolling(0).sum()", "n.rolling(2)", "n.shift(n)", "n.rolling(2).median()"):
        with pytest.raises(ValueError):
            value(bad)
    with pytest.raises(ValueError, match="order_by"):
        df.select(column_expr("n.shift(1)", df))
    with pytest.raises(ValueError):
        C.add_many_computed(df, {"n": "n + 1"}, ["row id"])
