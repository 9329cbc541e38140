"""A null series is a series: operators give it what they give a named one, whatever the columns are called."""

import math

import pytest
from pyspark.sql import functions as F

from millrace.operators import changepoints as CP, panel as PN, timeseries as T


@pytest.fixture(scope="module")
def table(spark):
    rows = [(name, i, math.sin(i / 3) * 5 + i % 7 + (40 if i > 60 else 0) + shift) for name, shift in (("a", 0.0), ("b", 9.0)) for i in range(120)]
    return spark.createDataFrame(rows, "series string, at int, value double")


OPERATORS = {
    "autocorrelation": lambda d, s: PN.autocorrelation(d, "value", ["at"], [s], lags=4),
    "stationarity": lambda d, s: PN.stationarity(d, "value", ["at"], [s]),
    "moving_average": lambda d, s: PN.forecast(d, "value", ["at"], [s], steps=2, method="moving_average"),
    "smoothing": lambda d, s: PN.forecast(d, "value", ["at"], [s], steps=2),
    "change_points": lambda d, s: CP.change_points(d, "value", ["at"], [s]),
    "decompose": lambda d, s: T.decompose(d, "value", ["at"], 7, series=[s]),
    "arima": lambda d, s: T.arima_fit(d, "value", ["at"], 1, 0, 0, [s]),
    "residuals": lambda d, s: T.residual_anomalies(T.decompose(d, "value", ["at"], 7, series=[s]), "at", [s], sigma=1.0),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
@pytest.mark.parametrize("column", ["s", "n", "level"])
def test_null_series_is_kept(table, name, column):
    def rows(df):
        out = OPERATORS[name](df.withColumnRenamed("series", column), column)
        return sorted((tuple("b" if (c == column and v is None) else round(v, 8) if isinstance(v, float) else v for c, v in r.asDict().items())
                       for r in out.collect()), key=str)

    named = rows(table)
    assert named == rows(table.withColumn("series", F.expr("nullif(series, 'b')")))
    assert {r[0] for r in named} == {"a", "b"} if name != "change_points" else named


def test_bounds_of_a_moving_average_use_its_window(table):
    one = PN.forecast(table, "value", ["at"], ["series"], steps=1, method="moving_average", window=3).where("series = 'a'").first()
    last = [r.value for r in table.where("series = 'a' AND at BETWEEN 93 AND 95").collect()]
    mean = sum(last) / 3
    sd = math.sqrt(sum((x - mean) ** 2 for x in last) / 2)
    assert one.forecast == pytest.approx(mean) and one.upper - mean == pytest.approx(1.959963984540054 * sd)
