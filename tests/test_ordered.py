"""The bucketed and blocked paths equal plain windows, whatever the partitioning."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W, functions as F

from millrace import ordered
from millrace.operators import missing as M


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    n = 700
    pdf = pd.DataFrame({
        "id": np.arange(n), "at": rng.integers(0, 60, n),  # heavy ties in the order column
        "who": np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abc"), n)),
        "v": np.where(rng.random(n) < 0.5, np.nan, rng.normal(size=n)),
    })
    return spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).cache()


def plain(series):
    return (W.partitionBy(*series) if series else W.partitionBy(F.lit(0))).orderBy("at", "id")


def same(a, b, columns):
    x = a.select("id", *columns).toPandas().set_index("id").sort_index()
    y = b.select("id", *columns).toPandas().set_index("id").sort_index()
    pd.testing.assert_frame_equal(x, y, check_dtype=False)


@pytest.mark.parametrize("series", [[], ["who"]])
@pytest.mark.parametrize("parts", [1, 7])
def test_split_paths_equal_plain_windows(table, split_always, series, parts):
    df, w, order = table.repartition(parts), plain(series), ["at", "id"]
    run = w.rowsBetween(W.unboundedPreceding, 0)
    want = table.select(
        "id", F.last("v", True).over(run).alias("f"), F.first("v", True).over(w.rowsBetween(0, W.unboundedFollowing)).alias("b"),
        F.sum("id").over(run).alias("s"), (F.row_number().over(w) - 1).alias("p"), F.lag("id", 3).over(w).alias("lag"),
        F.sum("id").over(w.rowsBetween(-4, 2)).alias("m"))
    out = ordered.fill_along(df, ["v"], order, series, {"v": "f"}, {"v": "b"})
    out = ordered.running_sum(out, order, {"s": F.col("id")}, series)
    out = ordered.with_position(out, order, series, "p")
    out = ordered.framed(out, order, lambda x: {"lag": F.lag("id", 3).over(x), "m": F.sum("id").over(x.rowsBetween(-4, 2))}, 4, 2, series)
    same(out, want, ["f", "b", "s", "p", "lag", "m"])


def test_totals(table, split_always):
    out = ordered.running_sum(table, ["at", "id"], {"s": F.lit(1)}, ["who"], totals={"n": F.lit(1)})
    want = table.groupBy("who").count().toPandas().set_index("who")["count"].to_dict()
    assert {r["who"]: r["n"] for r in out.select("who", "n").distinct().collect()} == want


def test_buckets_spread_a_hot_series(table, split_always):
    sizes = ordered.with_bucket(table, ["who", "at", "id"]).where("who = 'hot'").groupBy(ordered.BUCKET).count().collect()
    assert len(sizes) > 5 and max(r["count"] for r in sizes) < 150


@pytest.mark.parametrize("split", [False, True])
def test_interpolation_equals_pandas(spark, table, split):
    if split:
        spark.conf.set("millrace.smallGroup", "0")
        spark.conf.set("millrace.rowsPerBucket", "40")
    try:
        got = M.interpolate(table, "v", ["at", "id"]).toPandas().sort_values(["at", "id"])["v"]
    finally:
        spark.conf.unset("millrace.smallGroup")
        spark.conf.unset("millrace.rowsPerBucket")
    want = table.toPandas().sort_values(["at", "id"])["v"].interpolate()
    np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(float), atol=1e-12)


def test_order_is_required(table):
    with pytest.raises(ValueError):
        M.interpolate(table, "v", None)
