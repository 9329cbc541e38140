import numpy as np
import pandas as pd
import pytest

from millrace import quantiles as Q
from millrace.operators import scale as Z

PROBS = [0, 0.01, 0.25, 0.5, 0.9, 0.999, 1]


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(1)
    return pd.DataFrame({
        "g": np.where(rng.random(3000) < 0.5, "hot", rng.choice(list("xyz"), 3000)), "a": rng.normal(size=3000),
        "b": rng.integers(0, 7, 3000).astype(float), "c": np.where(rng.random(3000) < 0.4, 3.25, rng.exponential(size=3000)),
    })


@pytest.mark.parametrize("limit", [50_000, 20])
def test_column_quantiles_equal_pandas(spark, pdf, limit, monkeypatch):
    """With a tiny limit regions are counted before any value is picked."""
    monkeypatch.setattr(Q, "PICK_LIMIT", limit)
    got = Q.column_quantiles(spark.createDataFrame(pdf).repartition(5), ["a", "b", "c"], PROBS)
    want = pdf[["a", "b", "c"]].quantile(PROBS)
    for c in "abc":
        np.testing.assert_allclose(got[c], want[c], atol=1e-12)


def test_brackets_shrink(spark, monkeypatch):
    monkeypatch.setattr(Q, "PICK_LIMIT", 20)
    df = spark.range(150_000).selectExpr("randn(3) AS a", "IF(rand(4) < 0.4, 0.5, rand(5)) AS c", "floor(rand(6) * 40) AS d").cache()
    got, want = Q.column_quantiles(df, ["a", "c", "d"], PROBS), df.toPandas().quantile(PROBS)
    for c in "acd":
        np.testing.assert_allclose(got[c], want[c], atol=1e-12)


def test_no_values(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    assert Q.column_quantiles(df, ["x"], [0.5]) == {"x": [None]}


def test_group_quantiles_split(spark, pdf, split_always):
    got = Q.group_quantiles(spark.createDataFrame(pdf), ["g"], "c", [0.25, 0.5], ["l", "m"]).toPandas().set_index("g").sort_index()
    want = pdf.groupby("g")["c"].quantile([0.25, 0.5]).unstack()
    np.testing.assert_allclose(got[["l", "m"]], want, atol=1e-12)


def test_modes(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "a"), (2, "b"), (None, None)], "n int, s string")
    assert Q.column_modes(df, ["n", "s"]) == {"n": 1, "s": "a"}


def test_knots(spark, pdf):
    got = Z.column_knots(spark.createDataFrame(pdf), "c", 100)
    np.testing.assert_allclose(got, pdf["c"].quantile(np.linspace(0, 1, 100)), atol=1e-12)


@pytest.mark.parametrize("method", ["box_cox", "yeo_johnson"])
def test_power_exponent_is_the_best(spark, method):
    rng = np.random.default_rng(3)
    x = rng.lognormal(0.3, 0.6, 2000) if method == "box_cox" else rng.normal(1, 2, 2000)
    p = Z.fit(spark.createDataFrame(pd.DataFrame({"x": x})), ["x"], method)["x"]

    def likelihood(lam):
        if method == "box_cox":
            z, j = (x**lam - 1) / lam, np.log(x)
        else:
            pos = x >= 0
            z = np.where(pos, ((np.abs(x) + 1) ** lam - 1) / lam, -((np.abs(x) + 1) ** (2 - lam) - 1) / (2 - lam))
            j = np.sign(x) * np.log1p(np.abs(x))
        return (lam - 1) * j.mean() - np.log(z.var()) / 2

    grid = np.linspace(-2.0005, 3.0005, 20001)
    best = grid[np.argmax([likelihood(v) for v in grid])]
    assert abs(p["lambda"] - best) < 1e-3
