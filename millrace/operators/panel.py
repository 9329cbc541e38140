"""Many series at once: autocorrelation, stationarity tests, forecasts.

Sums over bounded blocks are grouped by (series, block) and added up by series; what is left of a series is one row with a short
array, which a small function finishes. No step walks over series on the driver or holds a whole series in a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from millrace import ordered
from millrace.operators import forecast as FC
from millrace.operators import timeseries as T
from millrace.session import cut_lineage


def _kinds(df: DataFrame, series: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in series)


def _centred(df: DataFrame, value: str, order_by: Sequence[str], series: Sequence[str]) -> DataFrame:
    """(series..., _at, _y, _m, _n): known values numbered once along the order, their mean and number by series."""
    data = df.where(F.col(value).isNotNull()).select(*series, *order_by, F.col(value).cast("double").alias("_y"))
    data = cut_lineage(ordered.with_position(data, order_by, series, "_at").select(*series, "_at", "_y"))
    stats = data.groupBy(*series).agg(F.avg("_y").alias("_m"), F.count("_y").alias("_n"))
    return ordered.by_series(data, cut_lineage(stats), series)


def _sums(data: DataFrame, series: Sequence[str], reach: int, extra: Sequence[str], compute: Callable) -> DataFrame:
    """(series..., extra..., _s): sums over blocks of ``compute(values, home, positions, extras)``; extras are constant by series."""
    blocks = ordered.blocked(data.select(*series, "_at", "_y", *extra), ["_at"], before=reach, series=series, rows=T.BLOCK_ROWS, position="_at")
    by = [*series, *extra]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ordered.POSITION)
        first = pdf.iloc[0]
        flat = np.asarray(compute(
            pdf["_y"].to_numpy(), pdf[ordered.HOME].to_numpy(bool), pdf[ordered.POSITION].to_numpy(), *[first[c] for c in extra]), float).ravel()
        named = {c: pd.Series([first[c]] * len(flat), dtype=object) for c in by}
        return pd.DataFrame({**named, "_i": np.arange(len(flat)), "_t": flat})

    cells = blocks.select(*by, ordered.BLOCK, ordered.POSITION, ordered.HOME, "_y").groupBy(*by, ordered.BLOCK).applyInPandas(
        run, f"{_kinds(data, by)}, _i int, _t double")
    sums = cells.groupBy(*by, "_i").agg(F.sum("_t").alias("_t"))
    return sums.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_t"))), lambda r: r["_t"]).alias("_s"))


def _finished(rows: DataFrame, keep: Sequence[str], fn: Callable, schema: str) -> DataFrame:
    """Per row of ``rows`` the rows that ``fn(row)`` returns as tuples, after the kept columns."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            out = [(*(row[c] for c in keep), *made) for _, row in pdf.iterrows() for made in fn(row)]
            yield pd.DataFrame(out, columns=[*keep, *names])

    return rows.mapInPandas(run, f"{_kinds(rows, keep)}, {schema}")


def _products(data: DataFrame, series: Sequence[str], reach: int, extra: Sequence[str] = ("_n", "_lags")) -> DataFrame:
    """``_s``: sums of z_t z_{t-k} for k = 0 .. ``_lags`` of the centred values."""
    def compute(z, home, _, n, lags):
        return T.shifted_products(z, home, int(lags))

    return _sums(data.withColumn("_y", F.col("_y") - F.col("_m")), series, reach, extra, compute)


def autocorrelation(df: DataFrame, value: str, order_by: Sequence[str], series: Sequence[str], lags: int = 40) -> DataFrame:
    """(series..., lag, acf, pacf) up to ``lags``, or half the rows of a shorter series."""
    data = _centred(df, value, order_by, series).withColumn("_lags", F.least(F.lit(lags), F.floor(F.col("_n") / 2)).cast("int"))

    def finish(row):
        s = np.array(row["_s"])
        r = s / s[0] if s[0] else np.full(len(s), np.nan)
        return [(k, float(r[k]), p) for k, p in enumerate(T.partial_correlations(r))]

    return _finished(_products(data, series, lags), series, finish, "lag int, acf double, pacf double")


def _partial_sums(data: DataFrame, series: Sequence[str]) -> DataFrame:
    """(series..., _parts): by block in order the rows, the sum of the centred values, and the sums of their running sums and of the squares of these."""
    blocks = ordered.blocked(data.select(*series, "_at", (F.col("_y") - F.col("_m")).alias("_z")), ["_at"], series=series, rows=T.BLOCK_ROWS, position="_at")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first, p = pdf.iloc[0], pdf.sort_values(ordered.POSITION)["_z"].to_numpy().cumsum()
        named = {c: pd.Series([first[c]], dtype=object) for c in series}
        return pd.DataFrame({**named, "_b": [first[ordered.BLOCK]], "_p": [[float(len(p)), p[-1], p.sum(), p @ p]]})

    parts = blocks.select(*series, ordered.BLOCK, ordered.POSITION, "_z").groupBy(*series, ordered.BLOCK).applyInPandas(
        run, f"{_kinds(data, series)}, _b long, _p array<double>")
    return parts.groupBy(*series).agg(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_p"))), lambda r: r["_p"]).alias("_parts"))


def kpss(df: DataFrame, value: str, order_by: Sequence[str], series: Sequence[str]) -> DataFrame:
    """(series..., kpss, pvalue, lags): level stationarity, lags chosen from the data of each series."""
    return _kpss(_centred(df, value, order_by, series), series)


def _kpss(data: DataFrame, series: Sequence[str]) -> DataFrame:
    most = data.agg(F.max("_n")).first()[0] or 1
    first = data.withColumn("_lags", F.floor(F.pow("_n", F.lit(2 / 9))).cast("int"))

    def choose(row):
        c, n = np.array(row["_s"]), row["_n"]
        s0 = c[0] / n + (2 * c[1:] / n).sum()
        s1 = (np.arange(1, len(c)) * 2 * c[1:] / n).sum()
        return [(int(min(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3), n - 1)) if s0 else 0,)]

    chosen = cut_lineage(_finished(_products(first, series, int(most ** (2 / 9)) + 1), series, choose, "_lags int"))
    second = ordered.by_series(data, chosen, series)
    reach = chosen.agg(F.max("_lags")).first()[0] or 0
    sums = _products(second, series, reach)

    def finish(row):
        c, n, lags = np.array(row["_s"]), row["_n"], int(row["_lags"])
        k = np.arange(1, lags + 1)
        long_run = (c[0] + 2 * (c[1:] * (1 - k / (lags + 1))).sum()) / n
        start = eta = 0.0
        for rows, total, once, square in row["_parts"]:
            eta += square + 2 * start * once + rows * start * start
            start += total
        stat = eta / n**2 / long_run if long_run else math.inf
        return [(float(stat), float(np.interp(stat, T.KPSS_CRITICAL, T.KPSS_P)), lags)]

    return _finished(ordered.by_series(sums, _partial_sums(data, series), series), series, finish, "kpss double, pvalue double, lags int")


def _gram(data: DataFrame, series: Sequence[str], reach: int) -> DataFrame:
    def compute(y, home, pos, n, lags):
        return T.lagged_gram(y, home, pos, int(lags))

    return _sums(data, series, reach + 1, ("_n", "_lags"), compute)


def _square(row) -> tuple[np.ndarray, int]:
    s = np.array(row["_s"])
    width = int(row["_lags"]) + 3
    return s[:-1].reshape(width, width), int(s[-1])


def adf(df: DataFrame, value: str, order_by: Sequence[str], series: Sequence[str], max_lag: int | None = None) -> DataFrame:
    """(series..., adf, pvalue, lags): unit-root test with a constant, lags by AIC in each series."""
    return _adf(_centred(df, value, order_by, series), series, max_lag)


def _adf(data: DataFrame, series: Sequence[str], max_lag: int | None = None) -> DataFrame:
    top = F.lit(max_lag) if max_lag is not None else F.greatest(F.lit(0), F.least(
        F.ceil(12 * F.pow(F.col("_n") / 100, F.lit(0.25))), F.floor(F.col("_n") / 2) - 2))
    first = data.withColumn("_lags", top.cast("int"))

    def choose(row):
        g, rows = _square(row)
        return [(min(range(int(row["_lags"]) + 1), key=lambda p: T._least_squares(g, rows, p)[1]),)]

    chosen = cut_lineage(_finished(_gram(first, series, first.agg(F.max("_lags")).first()[0] or 0), series, choose, "_lags int"))
    second = ordered.by_series(data, chosen, series)

    def finish(row):
        g, rows = _square(row)
        t = T._least_squares(g, rows, int(row["_lags"]))[0]
        return [(float(t), T.adf_pvalue(t), int(row["_lags"]))]

    return _finished(_gram(second, series, chosen.agg(F.max("_lags")).first()[0] or 0), series, finish, "adf double, pvalue double, lags int")


def stationarity(df: DataFrame, value: str, order_by: Sequence[str], series: Sequence[str]) -> DataFrame:
    """(series..., both tests and the verdict) for the series with at least ten values."""
    by = list(series)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by).count().where("count >= 10").select(*by)
    data = _centred(ordered.by_series(df, cut_lineage(counts), by, "left_semi"), value, order_by, by)
    both = ordered.by_series(_adf(data, by), _kpss(data, by).drop("lags").withColumnRenamed("pvalue", "_kp"), by)
    a, k = F.col("pvalue") < 0.05, F.col("_kp") > 0.05
    verdict = F.when(a & k, "stationary").when(~a & ~k, "non_stationary").otherwise("ambiguous")
    return both.select(*by, F.col("adf").alias("adf_statistic"), F.col("pvalue").alias("adf_pvalue"), a.alias("adf_is_stationary"),
                       F.col("kpss").alias("kpss_statistic"), F.col("_kp").alias("kpss_pvalue"), k.alias("kpss_is_stationary"), verdict.alias("final_verdict"))


def _smoothed(train: DataFrame, series: Sequence[str], trend: bool, period: int) -> DataFrame:
    """(series..., _level, _slope, _season, _v): the best smoothing of each series."""
    fitted = FC.fit_smoothing(train, series, trend, period)
    slope = F.get("_state", F.lit(1)) if trend else F.lit(0.0)
    return fitted.select(*series, F.get("_state", F.lit(0)).alias("_level"), slope.alias("_slope"),
                         F.slice("_state", 2 + trend, max(period, 1)).alias("_season"), "_v")


def forecast(df: DataFrame, value: str, order_by: Sequence[str], series: Sequence[str], steps: int = 10, method: str = "exponential_smoothing",
             train_pct: float = 80, confidence: float = 95, window: int = 5, trend: bool = False, period: int = 0) -> DataFrame:
    """(series..., step, forecast, lower, upper) after the training part of each series.

    A season is used as given for every series; a series shorter than two periods is forecast from what it has.
    """
    by = list(series)
    data = cut_lineage(ordered.with_position(
        df.where(F.col(value).isNotNull()).select(*by, *order_by, F.col(value).cast("double").alias("_y")), order_by, by, "_at").select(*by, "_at", "_y"))
    sizes = cut_lineage(data.groupBy(*by).agg(F.floor(F.count("_y") * train_pct / 100).alias("_size")))
    train = ordered.by_series(data, sizes, by).where("_at < _size").select(*by, "_at", "_y", "_size")
    tail = train.where(F.col("_at") >= F.col("_size") - max(window, 10))
    last = tail.groupBy(*by, "_size").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_y"))), lambda r: r["_y"]).alias("_last"))
    z = NormalDist().inv_cdf(1 - (100 - confidence) / 200)

    def pieces(n: int):
        part = F.slice("_last", F.greatest(F.size("_last") - n + 1, F.lit(1)), n)
        mean = F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / F.size(part)
        square = F.aggregate(F.transform(part, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x)
        return mean, F.when(F.size(part) > 1, F.sqrt(square / (F.size(part) - 1)))

    if method in ("moving_average", "naive"):
        mean, spread = pieces(window)
        if method == "naive":
            mean, spread = F.element_at("_last", -1), pieces(10)[1]
        made = last.select(*by, mean.alias("_f"), spread.alias("_sd"))
        made = made.select(*by, F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("_step"), "_f", "_sd")
    elif method == "exponential_smoothing":
        state = ordered.by_series(_smoothed(train.select(*by, "_at", "_y"), by, trend, period), sizes, by)
        made = state.select(*by, F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("_step"), "_level", "_slope", "_season", "_size", F.sqrt("_v").alias("_sd"))
        season = F.get("_season", ((F.col("_size") + F.col("_step") - 1) % max(period, 1)).cast("int")) if period else F.lit(0.0)
        made = made.select(*by, "_step", (F.col("_level") + F.col("_step") * F.col("_slope") + season).alias("_f"), "_sd")
    else:
        raise ValueError(f"unknown method {method}")
    return made.select(*by, F.col("_step").cast("int").alias("step"), F.col("_f").alias("forecast"),
                       (F.col("_f") - z * F.col("_sd")).alias("lower"), (F.col("_f") + z * F.col("_sd")).alias("upper"))
