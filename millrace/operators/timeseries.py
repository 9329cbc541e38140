"""Time series: resampling, audit of recording changes, decomposition, stationarity, forecasts.

A series is a table with a time column, a value column and optional series columns. Work that
depends on order runs in bounded blocks with borders (``ordered.blocked``), so one very long
series is spread over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from datetime import datetime, timedelta
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import StringType, TimestampNTZType

from millrace import ordered
from millrace.operators import arima
from millrace.operators import missing as M
from millrace.operators.profile import _micros, as_timestamp, is_date_column
from millrace.operators.values import DATE_FORMATS, DATETIME_FORMATS
from millrace.quantiles import count_quantiles, literal

# Resampling rule -> length of a period.
BLOCK_ROWS = 100_000  # rows whose lagged products one task sums
RULES = {"Y": "1 YEAR", "M": "1 MONTH", "W": "7 DAY", "D": "1 DAY", "h": "1 HOUR", "min": "1 MINUTE", "s": "1 SECOND"}


def date_columns(df: DataFrame) -> list[str]:
    """Date types, and string columns of which more than nine tenths parse."""
    return [c for c in df.columns if is_date_column(df, c, 0.9)]


def set_time_axis(df: DataFrame, column: str, day_first: bool = False, name: str = "ts") -> DataFrame:
    """Add the time column; a column without any readable date raises."""
    if isinstance(df.schema[column].dataType, StringType):
        formats = sorted(DATETIME_FORMATS + DATE_FORMATS, key=lambda f: f.startswith("dd") != day_first)
        ts = F.coalesce(as_timestamp(df, column), *[F.try_to_timestamp(F.trim(column), F.lit(f)).cast("timestamp_ntz") for f in formats])
    else:
        ts = as_timestamp(df, column)
    out = df.withColumn(name, ts)
    if out.where(F.col(name).isNotNull()).limit(1).count() == 0:
        raise ValueError(f"{column} holds no date")
    return out


def _label(start: Column, rule: str) -> Column:
    """Years, months and weeks are labelled by their last day, the others by their start."""
    if rule == "Y":
        return F.expr("INTERVAL 1 YEAR") + start - F.expr("INTERVAL 1 DAY")
    if rule == "M":
        return F.expr("INTERVAL 1 MONTH") + start - F.expr("INTERVAL 1 DAY")
    return start + F.expr("INTERVAL 6 DAY") if rule == "W" else start


def resample(df: DataFrame, ts: str, value: str, rule: str, series: Sequence[str] = (), fill: bool = True) -> DataFrame:
    """(series..., ts, value): mean per period, gaps filled linearly."""
    step = f"INTERVAL {RULES[rule]}"
    time = F.col(ts).cast("timestamp_ntz")
    if rule in ("Y", "M"):
        start = F.trunc(time, "year" if rule == "Y" else "month").cast("timestamp_ntz")
    else:  # windows without time zone do not depend on the session's; weeks start on Monday
        start = F.window("_t", RULES[rule], startTime="4 days" if rule == "W" else "0 seconds")["start"]
    means = df.withColumn("_t", time).withColumn("_p", start).groupBy(*series, "_p").agg(F.avg(value).alias(value))
    ends = means.groupBy(*series).agg(F.min("_p").alias("_a"), F.max("_p").alias("_b"))
    if rule in ("h", "min", "s"):  # by day first, so that no single array holds a whole series
        days = ends.select("*", F.explode(F.sequence(F.col("_a").cast("date").cast("timestamp_ntz"), "_b", F.expr("INTERVAL 1 DAY"))).alias("_d"))
        slots = days.select(*series, "_a", "_b", F.explode(F.sequence(
            "_d", F.col("_d") + F.expr("INTERVAL 1 DAY") - F.expr(step), F.expr(step))).alias("_p")).where("_p BETWEEN _a AND _b")
    else:
        slots = ends.select(*series, F.explode(F.sequence("_a", "_b", F.expr(step))).alias("_p"))
    full = ordered.by_series(slots.select(*series, "_p"), means, [*series, "_p"], "left")
    if fill:
        full = M.interpolate(full, value, ["_p"], series)
    return full.select(*series, _label(F.col("_p"), rule).cast("timestamp_ntz").alias(ts), value)


def rolling_mean(df: DataFrame, column: str, window: int, order_by: Sequence[str], series: Sequence[str] = (),
                 min_rows: int | None = None, name: str | None = None) -> DataFrame:
    """Mean of the last ``window`` rows; NULL with fewer than ``min_rows`` (default: all) values."""
    need = window if min_rows is None else min_rows

    def build(w):
        frame = w.rowsBetween(-(window - 1), 0)
        return {name or f"{column}_mean": F.when(F.count(column).over(frame) >= need, F.avg(column).over(frame))}

    return ordered.framed(df, order_by, build, before=window - 1, series=series)


def difference(df: DataFrame, column: str, order_by: Sequence[str], lag: int = 1, order: int = 1,
               series: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """Difference at a lag, ``order`` times."""
    name = name or f"{column}_diff"
    stages = [
        lambda w, src=(column if i == 0 else f"_d{i - 1}"), out=(name if i == order - 1 else f"_d{i}"):
        {out: F.col(src) - F.lag(src, lag).over(w)} for i in range(order)
    ]
    return ordered.framed(df, order_by, stages, before=lag * order, series=series).drop(*[f"_d{i}" for i in range(order - 1)])


# --- audit of recording changes -------------------------------------------------------------


def audit_windows(df: DataFrame, ts: str, value: str, window_days: float = 14, overlap_pct: float = 50,
                  series: Sequence[str] = (), min_rows: int = 10) -> DataFrame:
    """One row of statistics per sliding window from the first timestamp (of each series).

    Windows end exclusive and are cut at the last timestamp, whose row is therefore in none;
    windows with fewer than ``min_rows`` rows are left out. Each row goes to
    100 / (100 - overlap) windows.
    """
    data = df.where(F.col(value).isNotNull()).select(*series, F.col(ts).alias("_ts"), F.col(value).cast("double").alias("v"))
    data = data.withColumn("_ts", F.col("_ts").cast("timestamp_ntz"))
    width, slide = (round(d * 86_400_000_000) for d in (window_days, window_days * (1 - overlap_pct / 100)))
    span = data.groupBy(*series).agg(F.min("_ts").alias("_lo"), F.max("_ts").alias("_hi"))
    if series:
        data = ordered.by_series(data, span, series)
    else:
        lo, hi = span.first()
        data = data.withColumns({"_lo": literal(lo, TimestampNTZType()), "_hi": literal(hi, TimestampNTZType())})
    # A row at t microseconds after the first one is in the windows i with i * slide <= t < i * slide + width.
    at = _micros(F.col("_ts")) - _micros(F.col("_lo"))
    until = F.floor(at / slide).cast("bigint")
    since = F.greatest(F.lit(0), F.floor((at - width) / slide) + 1).cast("bigint")
    shift = lambda micros: F.col("_lo") + F.make_dt_interval(
        F.floor(micros / 86_400_000_000).cast("int"), F.lit(0), F.lit(0), ((micros % 86_400_000_000) / F.lit(1_000_000)).cast("decimal(18,6)"))
    placed = data.where(F.col("_ts") < F.col("_hi")).withColumn("_i", F.explode(F.sequence(since, until))).select(
        *series, shift(F.col("_i") * slide).alias("window_start"),
        F.least(shift(F.col("_i") * slide + width), F.col("_hi")).alias("window_end"), "v")
    by = [*series, "window_start", "window_end"]
    stats = placed.groupBy(*by).agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"),
        F.max("v").alias("max"), (F.avg((F.col("v") == 0).cast("int")) * 100).alias("zeros_pct"),
        (F.avg((F.col("v") < 0).cast("int")) * 100).alias("negatives_pct"), F.skewness("v").alias("skewness"),
        F.kurtosis("v").alias("kurtosis"), F.min(F.col("v") == F.floor("v")).alias("whole"),
    ).where(F.col("count") >= min_rows)
    counts = placed.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("n"))
    quart = count_quantiles(counts, by, "v", "n", [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    kinds = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("unique_values"))
    # The step between neighbouring values, over the 100 smallest of each window.
    low = counts.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy("v"))).where("_r <= 100")
    gaps = low.withColumn("_g", F.col("v") - F.lag("v").over(W.partitionBy(*by).orderBy("_r")))
    step = gaps.groupBy(*by).agg(F.expr("percentile(_g, 0.5)").alias("typical_step"))  # at most 99 values
    out = stats
    for side, how in ((quart, "inner"), (kinds, "inner"), (step, "left")):
        out = ordered.by_series(out, side, by, how)
    return out.withColumns({
        "iqr": F.col("q3") - F.col("q1"), "cv": F.when(F.col("mean") == 0, 0.0).otherwise(F.try_divide("std", "mean")),
        "days": F.floor((_micros(F.col("window_end")) - _micros(F.col("window_start"))) / 86_400_000_000),
        "typical_step": F.when(F.col("unique_values") > 10, F.coalesce("typical_step", F.lit(0.0))),
    })


def audit_alerts(windows: DataFrame, series: Sequence[str] = (), mean_pct: float = 30, std_pct: float = 50,
                 range_ratio: float = 2.0, iqr_pct: float = 75, extras: bool = True) -> DataFrame:
    """(series..., window_start, type, amount): each window against the one kept before it.

    A negative mean before gives a negative change, which never alerts. ``extras`` adds the
    spread and unit-scaling alerts.
    """
    order = (W.partitionBy(*series) if series else W.partitionBy(F.lit(0))).orderBy("window_start")  # few rows
    seen = windows.withColumn("_i", F.row_number().over(order)).withColumn(
        "_whole", F.when((F.col("unique_values") > 10) & (F.col("_i") > 1), F.col("whole")))
    names = ["mean", "std", "min", "max", "unique_values", "iqr", "typical_step", "_whole"]
    seen = seen.withColumns({f"p_{c}": F.lag(c).over(order) for c in names}).where("_i > 1")
    c = F.col
    pct = lambda n: F.try_divide(F.abs(c(n) - c(f"p_{n}")), c(f"p_{n}")) * 100
    ratio = F.when(c("p_max") > c("p_min"), (c("max") - c("min")) / (c("p_max") - c("p_min")))
    kinds = c("unique_values") / c("p_unique_values")
    many = c("unique_values") > 10
    step = F.when((c("typical_step") > 0) & (c("p_typical_step") > 0), c("typical_step") / F.nullif(c("p_typical_step"), F.lit(0)))
    alerts = {
        "mean_shift": (pct("mean") > mean_pct, pct("mean")), "std_shift": (pct("std") > std_pct, pct("std")),
        "range_expansion": (ratio > range_ratio, ratio), "range_contraction": (ratio < 1 / range_ratio, ratio),
        "type_conversion": (many & (c("_whole") != c("p__whole")), c("_whole").cast("double")),
        "precision_increase": (many & (kinds > 3), kinds), "precision_decrease": (many & (kinds < 0.33), kinds),
    }
    if extras:
        alerts |= {
            "iqr_shift": (pct("iqr") > iqr_pct, pct("iqr")),
            "unit_scaled_down": (many & (step > 0.05) & (step < 0.2), 1 / step), "unit_scaled_up": (many & (step > 5) & (step < 20), step),
        }
    rows = F.array_compact(F.array(*[
        F.when(test, F.struct(F.lit(n).alias("type"), amount.cast("double").alias("amount"))) for n, (test, amount) in alerts.items()
    ]))
    return seen.select(*series, "window_start", F.explode(rows).alias("a")).select(*series, "window_start", "a.type", "a.amount")


# --- decomposition --------------------------------------------------------------------------


def decompose(df: DataFrame, value: str, order_by: Sequence[str], period: int = 7, model: str = "additive",
              series: Sequence[str] = ()) -> DataFrame:
    """Add trend (centred moving average), seasonal (mean by phase, centred) and residual."""
    data = df.where(F.col(value).isNotNull())
    half, y = period // 2, F.col(value).cast("double")

    def build(w):
        inner = F.sum(y).over(w.rowsBetween(-half, half))
        if period % 2 == 0:  # an even period counts both ends half
            inner = inner - 0.5 * (F.lag(y, half).over(w) + F.lead(y, half).over(w))
        whole = F.count(y).over(w.rowsBetween(-half, half)) == 2 * half + 1
        return {"trend": F.when(whole, inner / period)}

    out = ordered.framed(data, order_by, build, half, half, series, position="_at")
    add = model == "additive"
    out = out.withColumn("_phase", F.col("_at") % period).withColumn("_free", y - F.col("trend") if add else y / F.col("trend"))
    per = out.groupBy(*series, "_phase").agg(F.avg("_free").alias("_s"))
    mean = F.avg("_s").over(W.partitionBy(*series) if series else W.partitionBy(F.lit(0)))  # `period` rows
    side = per.select(*series, "_phase", (F.col("_s") - mean if add else F.col("_s") / mean).alias("seasonal"))
    out = out.join(F.broadcast(side), "_phase") if not series else ordered.by_series(out, side, [*series, "_phase"])
    residual = F.col("_free") - F.col("seasonal") if add else F.col("_free") / F.col("seasonal")
    return out.select(*df.columns, "trend", "seasonal", residual.alias("residual"))


def decomposition_strength(parts: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """(series..., trend_strength, seasonal_strength): 1 - var(residual) / var(part), 0 for a flat part."""
    one = lambda c: F.when(F.var_pop(c) > 0, 1 - F.try_divide(F.var_pop("residual"), F.var_pop(c))).otherwise(0.0)
    return parts.groupBy(*series).agg(one("trend").alias("trend_strength"), one("seasonal").alias("seasonal_strength"))


def residual_anomalies(parts: DataFrame, ts: str, series: Sequence[str] = (), sigma: float = 3.0) -> DataFrame:
    """(series..., ts, residual, deviation_sigma) of residuals beyond ``sigma`` standard deviations."""
    stats = parts.groupBy(*series).agg(F.avg("residual").alias("_m"), F.stddev_samp("residual").alias("_s"))
    both = parts.join(F.broadcast(stats)) if not series else ordered.by_series(parts, stats, series)
    away = F.abs(F.col("residual") - F.col("_m"))
    return both.where(away > sigma * F.col("_s")).select(
        *series, ts, "residual", (away / F.nullif(F.col("_s"), F.lit(0.0))).alias("deviation_sigma"))


# --- stationarity ---------------------------------------------------------------------------

# Published response surface of the unit-root test (constant, no trend) and
# critical values of the KPSS level test with their probabilities.
ADF_SMALL, ADF_LARGE = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
ADF_MIN, ADF_MAX, ADF_SPLIT = -18.83, 2.74, -1.61
KPSS_CRITICAL, KPSS_P = (0.347, 0.463, 0.574, 0.739), (0.10, 0.05, 0.025, 0.01)


def _block_sums(df: DataFrame, value: str, order_by: Sequence[str], reach: int,
                compute: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over blocks of ``compute(values, home, positions)`` (a small fixed array).

    Every block is bounded and holds the ``reach`` rows before it; one short row per block is
    added up by Spark.
    """
    data = ordered.blocked(df.select(*order_by, F.col(value).cast("double").alias("_y")), order_by, before=reach, rows=BLOCK_ROWS)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ordered.POSITION)
        out = compute(pdf["_y"].to_numpy(), pdf[ordered.HOME].to_numpy(bool), pdf[ordered.POSITION].to_numpy())
        flat = np.asarray(out, float).ravel()
        return pd.DataFrame({"i": np.arange(len(flat)), "s": flat})

    data = data.select(ordered.BLOCK, ordered.POSITION, ordered.HOME, "_y")
    sums = data.groupBy(ordered.BLOCK).applyInPandas(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s"))
    return np.array([r["s"] for r in sums.orderBy("i").collect()])


def shifted_products(z: np.ndarray, home: np.ndarray, lags: int) -> np.ndarray:
    """Sums of z_t z_{t-k} over the home rows t (consecutive) of a block, for k = 0..lags."""
    at = np.flatnonzero(home)
    if not len(at):
        return np.zeros(lags + 1)
    first, end = int(at[0]), int(at[-1]) + 1
    return np.array([z[max(first, k):end] @ z[max(first, k) - k:max(end - k, 0)] if end > k else 0.0 for k in range(lags + 1)])


def lag_products(df: DataFrame, value: str, order_by: Sequence[str], lags: int) -> tuple[np.ndarray, int]:
    """Sums of (y_t - mean)(y_{t-k} - mean) for k = 0..lags, and the number of rows."""
    mean, n = df.agg(F.avg(value), F.count(value)).first()
    return _block_sums(df, value, order_by, lags, lambda y, home, _: shifted_products(y - mean, home, lags)), n


def partial_correlations(r: np.ndarray) -> list[float]:
    """Partial autocorrelations from autocorrelations, by Levinson's recursion on a few dozen numbers."""
    pacf, phi = [1.0], np.zeros(0)
    for k in range(1, len(r)):
        last = (r[k] - phi @ r[k - 1:0:-1]) / (1 - phi @ r[1:k]) if k > 1 else r[1]
        phi = np.append(phi - last * phi[::-1], last)
        pacf.append(float(last))
    return pacf


def autocorrelation(df: DataFrame, value: str, order_by: Sequence[str], lags: int | None = None) -> DataFrame:
    """(lag, acf, pacf) up to ``lags`` (default min(40, n / 2)); pacf by Yule-Walker."""
    n = df.where(F.col(value).isNotNull()).count()
    lags = min(40, n // 2) if lags is None else lags
    products, _ = lag_products(df.where(F.col(value).isNotNull()), value, order_by, lags)
    r = products / products[0]
    pacf = partial_correlations(r)
    rows = [(k, float(r[k]), pacf[k]) for k in range(lags + 1)]
    return df.sparkSession.createDataFrame(rows, "lag int, acf double, pacf double")


def lagged_gram(y: np.ndarray, home: np.ndarray, pos: np.ndarray, lags: int) -> np.ndarray:
    """Cross products of [dy_t, 1, y_{t-1}, dy_{t-1} .. dy_{t-lags}] over the home rows t with every lag, then their number.

    A product of two lagged differences is that of the lags one less, with a row more at the start and one less at the end: only
    the products with dy_t and y_{t-1} run over the rows, and no table of all lags is made.
    """
    width = lags + 3
    at = np.flatnonzero(home & (pos >= lags + 1))
    if not len(at):
        return np.zeros(width * width + 1)
    d, first, end = np.diff(y, prepend=np.nan), int(at[0]), int(at[-1]) + 1
    ends = np.arange(1, lags + 1)
    into, out, now, before = d[first - ends], d[end - ends], d[first:end], y[first - 1:end - 1]
    products, sums, levels = (np.zeros(lags + 1) for _ in range(3))
    for k in range(lags + 1):
        lagged = d[first - k:end - k]
        products[k], levels[k] = now @ lagged, before @ lagged
    sums[0] = now.sum()
    sums[1:] = sums[0] + np.cumsum(into - out)
    both = np.zeros((lags + 1, lags + 1))
    both[0] = both[:, 0] = products
    for i in range(lags):
        both[i + 1, 1:] = both[i, :-1] + into[i] * into - out[i] * out
    gram, place = np.zeros((width, width)), np.array([0, *range(3, width)])
    gram[np.ix_(place, place)] = both
    gram[1, place] = gram[place, 1] = sums
    gram[2, place] = gram[place, 2] = levels
    gram[1, 1], gram[2, 2] = len(at), before @ before
    gram[1, 2] = gram[2, 1] = before.sum()
    return np.append(gram.ravel(), len(at))


def _gram(df: DataFrame, value: str, order_by: Sequence[str], lags: int) -> tuple[np.ndarray, int]:
    """``lagged_gram`` over all rows with every lag."""
    width = lags + 3
    sums = _block_sums(df, value, order_by, lags + 1, lambda y, home, pos: lagged_gram(y, home, pos, lags))
    return sums[:-1].reshape(width, width), int(sums[-1])


def _least_squares(g: np.ndarray, n: int, lags: int) -> tuple[float, float]:
    """(t value of y_{t-1}, AIC) with the first ``lags`` differences."""
    x, xy = g[1:lags + 3, 1:lags + 3], g[1:lags + 3, 0]
    inv = np.linalg.pinv(x)
    beta = inv @ xy
    rss = max(g[0, 0] - beta @ xy, 1e-300)
    k = lags + 2
    aic = n * (math.log(2 * math.pi * rss / n) + 1) + 2 * k
    return beta[1] / math.sqrt(max(rss / (n - k) * inv[1, 1], 1e-300)), aic


def adf_test(df: DataFrame, value: str, order_by: Sequence[str], max_lag: int | None = None) -> tuple[float, float, int]:
    """(statistic, p value, lags): unit-root test with a constant, lags by AIC."""
    n = df.count()
    top = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2) if max_lag is None else max_lag
    g, rows = _gram(df, value, order_by, top)
    best = min(range(top + 1), key=lambda p: _least_squares(g, rows, p)[1])
    g, rows = _gram(df, value, order_by, best)
    t = _least_squares(g, rows, best)[0]
    return t, adf_pvalue(t), best


def adf_pvalue(t: float) -> float:
    if t > ADF_MAX or t < ADF_MIN:
        return float(t > ADF_MAX)
    coefs = ADF_SMALL if t <= ADF_SPLIT else ADF_LARGE
    return NormalDist().cdf(sum(c * t**i for i, c in enumerate(coefs)))


def kpss_test(df: DataFrame, value: str, order_by: Sequence[str]) -> tuple[float, float, int]:
    """(statistic, p value, lags): level stationarity, lags chosen from the data."""
    mean, n = df.agg(F.avg(value), F.count(value)).first()
    first = int(n ** (2 / 9))
    c, _ = lag_products(df, value, order_by, first)
    s0 = c[0] / n + sum(2 * c[i] / n for i in range(1, first + 1))
    s1 = sum(i * 2 * c[i] / n for i in range(1, first + 1))
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    c, _ = lag_products(df, value, order_by, lags)
    long_run = (c[0] + 2 * sum(c[i] * (1 - i / (lags + 1)) for i in range(1, lags + 1))) / n
    run = ordered.running_sum(df.select(*order_by, value), order_by, {"_s": F.col(value) - F.lit(mean)})
    eta = run.agg(F.sum(F.col("_s") * F.col("_s"))).first()[0] / n**2
    stat = eta / long_run if long_run else math.inf
    return stat, float(np.interp(stat, KPSS_CRITICAL, KPSS_P)), lags


def stationarity(df: DataFrame, value: str, order_by: Sequence[str], diff_level: int = 0) -> DataFrame:
    """One row: both tests and the verdict; ``diff_level`` is a lag, as the differences are."""
    data = df.where(F.col(value).isNotNull()).select(*order_by, F.col(value).cast("double").alias(value))
    if diff_level:
        data = difference(data, value, order_by, lag=diff_level, name="_d").select(*order_by, F.col("_d").alias(value)).where(F.col(value).isNotNull())
    if data.limit(10).count() < 10:
        raise ValueError("not enough data")
    adf, adf_p, _ = adf_test(data, value, order_by)
    kpss, kpss_p, _ = kpss_test(data, value, order_by)
    a, k = adf_p < 0.05, kpss_p > 0.05
    verdict = "stationary" if a and k else "non_stationary" if not a and not k else "ambiguous"
    return df.sparkSession.createDataFrame(
        [(float(adf), float(adf_p), a, float(kpss), float(kpss_p), k, verdict)],
        "adf_statistic double, adf_pvalue double, adf_is_stationary boolean, kpss_statistic double, "
        "kpss_pvalue double, kpss_is_stationary boolean, final_verdict string")


# --- autoregressive fit ---------------------------------------------------------------------


def arima_fit(df: DataFrame, value: str, order_by: Sequence[str], p: int = 1, d: int = 0, q: int = 0,
              series: Sequence[str] = ()) -> DataFrame:
    """Add ``fitted``: in-sample one-step values of an ARIMA(p, d, q) with a constant, fitted to each series by conditional least squares.

    Series are their known values in order. The first p + d of them, rows without a value, and series with no more values than
    parameters get NULL.
    """
    placed, errors, _ = arima.fitted_errors(df, value, order_by, p, d, q, series)
    by = list(series) or ["_all"]
    out = ordered.by_series(placed, errors, [*by, "_at"], "left").select(*df.columns, (F.col(value).cast("double") - F.col("_e")).alias("fitted"))
    return out.unionByName(df.where(F.col(value).isNull()).withColumn("fitted", F.lit(None).cast("double")))
