"""Queries over time series."""

from pyspark.sql import functions as F

from millrace.operators import changepoints as CP
from millrace.operators import forecast as FC
from millrace.operators import panel as PN
from millrace.operators import timeseries as T
from millrace.plans.registry import query

KEY = ["ts", "event_id"]


def _events(t):
    return t.events.select("event_id", "ts", "event_type", "user_id", "value")


HOURLY = """h AS (SELECT date_trunc('hour', ts) AS ts, avg(value) AS value FROM events GROUP BY 1)"""


def hourly(t):
    return T.resample(_events(t), "ts", "value", "h", fill=False).where("value IS NOT NULL")


@query("date_columns", "T-1", """SELECT unnest(['ts', 'day']) AS "column" FROM events WHERE event_id = 0""")
def date_columns(t):
    df = t.events.select("event_id", "ts", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type")
    return t.spark.createDataFrame([(c,) for c in T.date_columns(df)], "column string")


@query("set_time_axis", "T-1", "SELECT event_id, date_trunc('day', ts)::TIMESTAMP AS at FROM events")
def set_time_axis(t):
    df = t.events.select("event_id", F.date_format("ts", "dd/MM/yyyy").alias("day"))
    return T.set_time_axis(df, "day", day_first=True, name="at").drop("day")


@query("resample_days", "T-2", "SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS ts, round(avg(value), 6) AS value FROM events GROUP BY ALL")
def resample_days(t):
    return T.resample(_events(t), "ts", "value", "D", ["event_type"]).withColumn("value", F.round("value", 6))


@query("resample_weeks", "T-2", "SELECT (date_trunc('week', ts) + INTERVAL 6 DAY)::TIMESTAMP AS ts, round(avg(value), 6) AS value FROM events GROUP BY 1")
def resample_weeks(t):
    return T.resample(_events(t), "ts", "value", "W").withColumn("value", F.round("value", 6))


@query("resample_months", "T-2", "SELECT (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH - INTERVAL 1 DAY)::TIMESTAMP AS ts, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 1")
def resample_months(t):
    return T.resample(t.orders.selectExpr("o_orderdate AS ts", "o_totalprice AS value"), "ts", "value", "M").withColumn("value", F.round("value", 4))


@query("resample_minutes_filled", "T-2", """
WITH m AS (SELECT date_trunc('minute', ts) AS p, avg(value) AS v FROM events GROUP BY 1),
g AS (SELECT unnest(generate_series((SELECT min(p) FROM m), (SELECT max(p) FROM m), INTERVAL 1 MINUTE)) AS p),
j AS (SELECT g.p, v, CASE WHEN v IS NOT NULL THEN epoch(g.p) / 60 END AS e FROM g LEFT JOIN m USING (p)),
f AS (SELECT *, count(v) OVER (ORDER BY p) AS a, count(v) OVER (ORDER BY p DESC) AS b FROM j),
k AS (SELECT *, max(v) OVER (PARTITION BY a) AS v0, max(e) OVER (PARTITION BY a) AS e0, max(v) OVER (PARTITION BY b) AS v1, max(e) OVER (PARTITION BY b) AS e1 FROM f)
SELECT p::TIMESTAMP AS ts, round(CASE WHEN v IS NOT NULL THEN v ELSE v0 + (v1 - v0) * (epoch(p) / 60 - e0) / (e1 - e0) END, 9) AS value FROM k""")
def resample_minutes(t):
    return T.resample(_events(t), "ts", "value", "min").withColumn("value", F.round("value", 9))


@query("moving_average_fit", "T-3 W-4", """
SELECT ts, value, round(CASE WHEN count(*) OVER w = 7 THEN avg(value) OVER w END, 6) AS fitted FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS ts, round(avg(value), 6) AS value FROM events GROUP BY 1)
WINDOW w AS (ORDER BY ts ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def moving_average_fit(t):
    daily = T.resample(_events(t), "ts", "value", "D").withColumn("value", F.round("value", 6))
    return T.rolling_mean(daily, "value", 7, ["ts"], name="fitted").withColumn("fitted", F.round("fitted", 6))


@query("difference_at_lag", "W-3", """
SELECT event_id, round(value - lag(value, 2) OVER (ORDER BY ts, event_id), 6) AS diff FROM events""")
def difference_at_lag(t):
    return T.difference(_events(t), "value", KEY, lag=2, name="diff").select("event_id", F.round("diff", 6).alias("diff"))


@query("difference_twice", "W-3", """
SELECT event_id, round(value - 2 * lag(value) OVER w + lag(value, 2) OVER w, 6) AS diff FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""")
def difference_twice(t):
    return T.difference(_events(t), "value", KEY, order=2, series=["event_type"], name="diff").select("event_id", F.round("diff", 6).alias("diff"))


@query("arima_ar1", "T-4", """
WITH a AS (SELECT event_id, value AS y, lag(value) OVER (ORDER BY ts, event_id) AS x FROM events), c AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a0 FROM a)
SELECT event_id, round(a0 + b * x, 5) AS fitted FROM a, c""")
def arima_ar1(t):
    return T.arima_fit(_events(t), "value", KEY, p=1).select("event_id", F.round("fitted", 5).alias("fitted"))


@query("arima_211", "T-4")
def arima_211(t):
    return T.arima_fit(_events(t), "value", KEY, p=2, d=1, q=1).select("event_id", "fitted")


@query("arima_by_type", "T-4", """
WITH a AS (SELECT event_id, event_type, value AS y, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS x FROM events),
c AS (SELECT event_type, regr_slope(y, x) AS b, regr_intercept(y, x) AS a0 FROM a GROUP BY event_type)
SELECT event_id, round(a0 + b * x, 5) AS fitted FROM a JOIN c USING (event_type)""")
def arima_by_type(t):
    return T.arima_fit(_events(t), "value", KEY, p=1, series=["event_type"]).select("event_id", F.round("fitted", 5).alias("fitted"))


@query("change_points", "T-5")
def change_points(t):
    return CP.change_points(hourly(t), "value", ["ts"])


@query("change_points_by_series", "T-5")
def change_points_by_series(t):
    return CP.change_points(_events(t), "value", KEY, ["event_type"])


@query("change_points_l1", "T-5")
def change_points_l1(t):
    return CP.change_points(hourly(t), "value", ["ts"], model="l1")


@query("change_points_rbf", "T-5")
def change_points_rbf(t):
    return CP.change_points(hourly(t), "value", ["ts"], model="rbf")


@query("segment_statistics", "T-5", """
WITH e AS (SELECT ts, value, (row_number() OVER (ORDER BY ts, event_id) - 1) // (SELECT count(*) // 4 FROM events) AS s FROM events)
SELECT s + 1 AS segment, min(ts) AS start, max(ts) AS "end", round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS samples FROM e GROUP BY s""")
def segment_statistics(t):
    n = t.events.count()
    marks = t.spark.createDataFrame([(i * (n // 4),) for i in range(1, n // (n // 4) + 1) if i * (n // 4) < n], "position bigint")
    out = CP.segments(_events(t), "value", KEY, marks)
    return out.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


AUDIT = """
b AS (SELECT min(ts) AS a, max(ts) AS z FROM events), s AS (SELECT unnest(range(0, 100)) AS i),
w AS (SELECT i, a + to_days((i * 7)::INT) AS window_start, least(a + to_days((i * 7 + 14)::INT), z) AS window_end FROM s, b WHERE a + to_days((i * 7)::INT) <= z),
r AS (SELECT w.*, value FROM w JOIN events ON ts >= window_start AND ts < window_end),
q AS (SELECT window_start, window_end, (epoch_us(window_end) - epoch_us(window_start)) // 86400000000 AS days, count(*) AS count, avg(value) AS mean, stddev_pop(value) AS std,
 min(value) AS min, max(value) AS max, median(value) AS median, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3,
 quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, count(DISTINCT value) AS unique_values, avg((value = 0)::INT) * 100 AS zeros_pct,
 avg((value < 0)::INT) * 100 AS negatives_pct, CASE WHEN avg(value) = 0 THEN 0 ELSE stddev_pop(value) / avg(value) END AS cv,
 kurtosis_pop(value) AS kurtosis, skewness(value) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)) AS skewness, bool_and(value = floor(value)) AS whole
 FROM r GROUP BY 1, 2 HAVING count(*) >= 10)"""
FLOATS = ["mean", "std", "median", "q1", "q3", "iqr", "zeros_pct", "negatives_pct", "cv", "kurtosis", "skewness"]


@query("audit_windows", "T-6 T-8", f"WITH {AUDIT} SELECT * EXCLUDE ({', '.join(FLOATS)}), {', '.join(f'round({c}, 5) AS {c}' for c in FLOATS)} FROM q")
def audit_windows(t):
    out = T.audit_windows(_events(t), "ts", "value").drop("typical_step")
    return out.withColumns({c: F.round(c, 5) for c in FLOATS})


@query("audit_windows_by_type", "T-6 T-8", """
WITH b AS (SELECT event_type, min(ts) AS a, max(ts) AS z FROM events GROUP BY 1), s AS (SELECT unnest(range(0, 100)) AS i),
w AS (SELECT event_type, a + to_days((i * 5)::INT) AS window_start, least(a + to_days((i * 5 + 10)::INT), z) AS window_end FROM s, b WHERE a + to_days((i * 5)::INT) <= z),
r AS (SELECT w.*, value FROM w JOIN events e ON e.event_type = w.event_type AND ts >= window_start AND ts < window_end)
SELECT event_type, window_start, window_end, count(*) AS count, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, count(DISTINCT value) AS unique_values
FROM r GROUP BY 1, 2, 3 HAVING count(*) >= 10""")
def audit_windows_by_type(t):
    out = T.audit_windows(_events(t), "ts", "value", window_days=10, series=["event_type"])
    return out.select("event_type", "window_start", "window_end", "count", F.round("mean", 6).alias("mean"), "min", "max", "unique_values")


@query("audit_typical_step", "T-8", f"""
WITH {AUDIT}, d AS (SELECT DISTINCT window_start, value FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY value) AS n FROM d),
g AS (SELECT window_start, value - lag(value) OVER (PARTITION BY window_start ORDER BY n) AS gap FROM k WHERE n <= 100)
SELECT window_start, round(median(gap), 6) AS typical_step FROM g JOIN q USING (window_start) WHERE unique_values > 10 GROUP BY 1""")
def audit_typical_step(t):
    out = T.audit_windows(_events(t), "ts", "value")
    return out.select("window_start", F.round("typical_step", 6).alias("typical_step"))


@query("audit_alerts", "T-7 T-8", f"""
WITH {AUDIT}, dv AS (SELECT DISTINCT window_start, value FROM r), rk AS (SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY value) AS n FROM dv),
gp AS (SELECT window_start, value - lag(value) OVER (PARTITION BY window_start ORDER BY n) AS gap FROM rk WHERE n <= 100),
sp AS (SELECT window_start, median(gap) AS st FROM gp GROUP BY 1), k AS (SELECT q.*, CASE WHEN unique_values > 10 THEN coalesce(st, 0) END AS step FROM q LEFT JOIN sp USING (window_start)),
p AS (SELECT *, lag(mean) OVER o AS m, lag(std) OVER o AS s, lag(max - min) OVER o AS r, lag(unique_values) OVER o AS u, lag(iqr) OVER o AS i,
 CASE WHEN step > 0 AND lag(step) OVER o > 0 THEN step / lag(step) OVER o END AS sr FROM k WINDOW o AS (ORDER BY window_start))
SELECT window_start, 'mean_shift' AS type, round(abs(mean - m) / m * 100, 4) AS amount FROM p WHERE abs(mean - m) / m * 100 > 0.5
UNION ALL SELECT window_start, 'std_shift', round(abs(std - s) / s * 100, 4) FROM p WHERE abs(std - s) / s * 100 > 0.5
UNION ALL SELECT window_start, 'range_expansion', round((max - min) / r, 4) FROM p WHERE (max - min) / r > 1.001
UNION ALL SELECT window_start, 'range_contraction', round((max - min) / r, 4) FROM p WHERE (max - min) / r < 1 / 1.001
UNION ALL SELECT window_start, 'precision_increase', round(unique_values / u, 4) FROM p WHERE unique_values > 10 AND unique_values / u > 3
UNION ALL SELECT window_start, 'precision_decrease', round(unique_values / u, 4) FROM p WHERE unique_values > 10 AND unique_values / u < 0.33
UNION ALL SELECT window_start, 'unit_scaled_down', round(1 / sr, 4) FROM p WHERE unique_values > 10 AND sr > 0.05 AND sr < 0.2
UNION ALL SELECT window_start, 'unit_scaled_up', round(sr, 4) FROM p WHERE unique_values > 10 AND sr > 5 AND sr < 20
UNION ALL SELECT window_start, 'iqr_shift', round(abs(iqr - i) / i * 100, 4) FROM p WHERE abs(iqr - i) / i * 100 > 0.5""")
def audit_alerts(t):
    windows = T.audit_windows(_events(t), "ts", "value")
    out = T.audit_alerts(windows, mean_pct=0.5, std_pct=0.5, range_ratio=1.001, iqr_pct=0.5)
    return out.withColumn("amount", F.round("amount", 4))


PARTS = f"""{HOURLY}, p AS (SELECT ts, value, row_number() OVER (ORDER BY ts) - 1 AS i FROM h),
t AS (SELECT *, CASE WHEN count(*) OVER w = 25 THEN (sum(value) OVER w - 0.5 * (lag(value, 12) OVER (ORDER BY i) + lead(value, 12) OVER (ORDER BY i))) / 24 END AS trend FROM p
 WINDOW w AS (ORDER BY i ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)),
g AS (SELECT i % 24 AS ph, avg(value - trend) AS s FROM t GROUP BY 1), c AS (SELECT ph, s - (SELECT avg(s) FROM g) AS seasonal FROM g),
d AS (SELECT ts, value, trend, seasonal, value - trend - seasonal AS residual FROM t JOIN c ON ph = i % 24)"""


# Weeks in which the recording changes: as it is, whole numbers, ten times as large, as it is again, nearly constant.
STAGED = """lo AS (SELECT min(ts) AS a, max(ts) AS z FROM events), e AS (SELECT ts, (epoch_us(ts) - epoch_us(a)) // 604800000000 AS w, value FROM events, lo),
ev AS (SELECT ts, w, CASE w WHEN 1 THEN floor(value / 20) WHEN 2 THEN value * 10 WHEN 4 THEN 5.0 + floor(value / 100) ELSE value END AS v FROM e WHERE ts < (SELECT z FROM lo)),
q AS (SELECT (SELECT a FROM lo) + to_days((w * 7)::INT) AS window_start, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS mn, max(v) AS mx, count(DISTINCT v) AS u,
 quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr, bool_and(v = floor(v)) AS whole FROM ev GROUP BY w HAVING count(*) >= 10),
dv AS (SELECT DISTINCT w, v FROM ev), rk AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY v) AS n FROM dv),
gp AS (SELECT w, v - lag(v) OVER (PARTITION BY w ORDER BY n) AS gap FROM rk WHERE n <= 100),
sp AS (SELECT (SELECT a FROM lo) + to_days((w * 7)::INT) AS window_start, median(gap) AS step FROM gp GROUP BY w),
j AS (SELECT q.*, CASE WHEN u > 10 THEN coalesce(step, 0) END AS step, row_number() OVER (ORDER BY window_start) AS i FROM q LEFT JOIN sp USING (window_start)),
k AS (SELECT *, CASE WHEN u > 10 AND i > 1 THEN whole END AS wh FROM j),
p AS (SELECT *, lag(mean) OVER o AS pm, lag(std) OVER o AS ps, lag(mx - mn) OVER o AS pr, lag(u) OVER o AS pu, lag(iqr) OVER o AS pi, lag(step) OVER o AS pt, lag(wh) OVER o AS pw FROM k WINDOW o AS (ORDER BY window_start)),
r AS (SELECT *, CASE WHEN step > 0 AND pt > 0 THEN step / pt END AS sr FROM p)"""


@query("audit_alerts_staged", "T-7 T-8", f"""
WITH {STAGED}, a AS (
SELECT window_start, 'mean_shift' AS type, abs(mean - pm) / pm * 100 AS amount FROM r WHERE abs(mean - pm) / nullif(pm, 0) * 100 > 30
UNION ALL SELECT window_start, 'std_shift', abs(std - ps) / ps * 100 FROM r WHERE abs(std - ps) / nullif(ps, 0) * 100 > 50
UNION ALL SELECT window_start, 'range_expansion', (mx - mn) / pr FROM r WHERE (mx - mn) / nullif(pr, 0) > 2
UNION ALL SELECT window_start, 'range_contraction', (mx - mn) / pr FROM r WHERE (mx - mn) / nullif(pr, 0) < 0.5
UNION ALL SELECT window_start, 'type_conversion', wh::INT::DOUBLE FROM r WHERE u > 10 AND wh <> pw
UNION ALL SELECT window_start, 'precision_increase', u / pu FROM r WHERE u > 10 AND u / pu > 3
UNION ALL SELECT window_start, 'precision_decrease', u / pu FROM r WHERE u > 10 AND u / pu < 0.33
UNION ALL SELECT window_start, 'iqr_shift', abs(iqr - pi) / pi * 100 FROM r WHERE abs(iqr - pi) / nullif(pi, 0) * 100 > 75
UNION ALL SELECT window_start, 'unit_scaled_down', 1 / sr FROM r WHERE u > 10 AND sr > 0.05 AND sr < 0.2
UNION ALL SELECT window_start, 'unit_scaled_up', sr FROM r WHERE u > 10 AND sr > 5 AND sr < 20)
SELECT window_start, type, round(amount, 4) AS amount FROM a""")
def audit_alerts_staged(t):
    lo = _events(t).agg(F.min("ts").alias("lo"))
    ev = _events(t).join(F.broadcast(lo)).withColumn("w", F.floor(F.timestamp_diff("MICROSECOND", F.col("lo"), F.col("ts")) / 604_800_000_000))
    v = F.when(F.col("w") == 1, F.floor(F.col("value") / 20)).when(F.col("w") == 2, F.col("value") * 10).when(
        F.col("w") == 4, 5.0 + F.floor(F.col("value") / 100)).otherwise(F.col("value"))
    windows = T.audit_windows(ev.select("ts", v.cast("double").alias("v")), "ts", "v", window_days=7, overlap_pct=0)
    return T.audit_alerts(windows).withColumn("amount", F.round("amount", 4))


@query("decompose_additive", "T-9", f"WITH {PARTS} SELECT ts::TIMESTAMP AS ts, round(trend, 9) AS trend, round(seasonal, 9) AS seasonal, round(residual, 9) AS residual FROM d")
def decompose_additive(t):
    out = T.decompose(hourly(t), "value", ["ts"], 24)
    return out.select("ts", *[F.round(c, 9).alias(c) for c in ("trend", "seasonal", "residual")])


@query("decompose_multiplicative", "T-9", f"""
WITH {HOURLY}, p AS (SELECT ts, value, row_number() OVER (ORDER BY ts) - 1 AS i FROM h),
t AS (SELECT *, CASE WHEN count(*) OVER w = 7 THEN avg(value) OVER w END AS trend FROM p WINDOW w AS (ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
g AS (SELECT i % 7 AS ph, avg(value / trend) AS s FROM t GROUP BY 1), c AS (SELECT ph, s / (SELECT avg(s) FROM g) AS seasonal FROM g)
SELECT ts::TIMESTAMP AS ts, value, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal, round(value / trend / seasonal, 6) AS residual FROM t JOIN c ON ph = i % 7""")
def decompose_multiplicative(t):
    out = T.decompose(hourly(t), "value", ["ts"], 7, "multiplicative")
    return out.withColumns({c: F.round(c, 6) for c in ("trend", "seasonal", "residual")})


@query("decomposition_strength", "T-9", f"""
WITH {PARTS} SELECT round(1 - var_pop(residual) / var_pop(trend), 5) AS trend_strength, round(1 - var_pop(residual) / var_pop(seasonal), 5) AS seasonal_strength FROM d""")
def decomposition_strength(t):
    out = T.decomposition_strength(T.decompose(hourly(t), "value", ["ts"], 24))
    return out.select(*[F.round(c, 5).alias(c) for c in out.columns])


@query("residual_anomalies", "T-9", f"""
WITH {PARTS}, s AS (SELECT avg(residual) AS m, stddev_samp(residual) AS sd FROM d)
SELECT ts::TIMESTAMP AS ts, round(residual, 5) AS residual, round(abs(residual - m) / sd, 5) AS deviation_sigma FROM d, s WHERE abs(residual - m) > 2 * sd""")
def residual_anomalies(t):
    out = T.residual_anomalies(T.decompose(hourly(t), "value", ["ts"], 24), "ts", sigma=2)
    return out.select("ts", F.round("residual", 5).alias("residual"), F.round("deviation_sigma", 5).alias("deviation_sigma"))


@query("stationarity", "T-10")
def stationarity(t):
    return T.stationarity(hourly(t), "value", ["ts"])


@query("kpss_statistic", "T-10", f"""
WITH {HOURLY}, z AS (SELECT ts, value - (SELECT avg(value) FROM h) AS y, row_number() OVER (ORDER BY ts) AS i, (SELECT count(*) FROM h) AS n FROM h),
l AS (SELECT k, sum(a.y * b.y) AS c FROM range(0, 60) r(k) JOIN z a ON true JOIN z b ON b.i = a.i + k GROUP BY k),
m AS (SELECT any_value(n) AS n, floor(pow(any_value(n), 2.0 / 9)) AS f FROM z),
s AS (SELECT sum(CASE WHEN k = 0 THEN c / n WHEN k <= f THEN 2 * c / n ELSE 0 END) AS s0, sum(CASE WHEN k BETWEEN 1 AND f THEN k * 2 * c / n ELSE 0 END) AS s1 FROM l, m),
g AS (SELECT floor(1.1447 * pow((s1 / s0) * (s1 / s0), 1.0 / 3) * pow(n, 1.0 / 3)) AS lags FROM s, m),
v AS (SELECT sum(CASE WHEN k = 0 THEN c WHEN k <= lags THEN 2 * c * (1 - k / (lags + 1)) ELSE 0 END) / any_value(n) AS v FROM l, g, m)
SELECT round((SELECT sum(p * p) FROM (SELECT sum(y) OVER (ORDER BY i) AS p FROM z)) / (n * n) / v, 5) AS kpss FROM v, m""")
def kpss_statistic(t):
    stat, _, _ = T.kpss_test(hourly(t), "value", ["ts"])
    return t.spark.createDataFrame([(round(float(stat), 5),)], "kpss double")


@query("autocorrelation", "T-11", f"""
WITH {HOURLY}, z AS (SELECT value - (SELECT avg(value) FROM h) AS y, row_number() OVER (ORDER BY ts) AS i FROM h)
SELECT k::INTEGER AS lag, round(sum(a.y * b.y) / (SELECT sum(y * y) FROM z), 6) AS acf FROM range(0, 41) r(k) JOIN z a ON true JOIN z b ON b.i = a.i + k GROUP BY k""")
def autocorrelation(t):
    return T.autocorrelation(hourly(t), "value", ["ts"]).select("lag", F.round("acf", 6).alias("acf"))


@query("acf_by_type", "T-11", """
WITH z AS (SELECT event_type, value - avg(value) OVER (PARTITION BY event_type) AS y, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
v AS (SELECT event_type, sum(y * y) AS v FROM z GROUP BY 1)
SELECT a.event_type, k::INTEGER AS lag, round(sum(a.y * b.y) / any_value(v), 6) AS acf FROM range(0, 41) r(k) JOIN z a ON true
JOIN z b ON b.event_type = a.event_type AND b.i = a.i + k JOIN v ON v.event_type = a.event_type GROUP BY 1, 2""")
def acf_by_type(t):
    return PN.autocorrelation(_events(t), "value", KEY, ["event_type"]).select("event_type", "lag", F.round("acf", 6).alias("acf"))


@query("kpss_by_type", "T-10", """
WITH z AS (SELECT event_type, value - avg(value) OVER w AS y, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY event_type)),
l AS (SELECT a.event_type, k, any_value(a.n) AS n, sum(a.y * b.y) AS c FROM range(0, 60) r(k) JOIN z a ON true JOIN z b ON b.event_type = a.event_type AND b.i = a.i + k GROUP BY 1, 2),
s AS (SELECT event_type, any_value(n) AS n, sum(CASE WHEN k = 0 THEN c / n WHEN k <= floor(pow(n, 2.0 / 9)) THEN 2 * c / n ELSE 0 END) AS s0,
 sum(CASE WHEN k BETWEEN 1 AND floor(pow(n, 2.0 / 9)) THEN k * 2 * c / n ELSE 0 END) AS s1 FROM l GROUP BY 1),
g AS (SELECT event_type, n, floor(1.1447 * pow((s1 / s0) * (s1 / s0), 1.0 / 3) * pow(n, 1.0 / 3)) AS lags FROM s),
v AS (SELECT event_type, sum(CASE WHEN k = 0 THEN c WHEN k <= lags THEN 2 * c * (1 - k / (lags + 1)) ELSE 0 END) / any_value(g.n) AS v FROM l JOIN g USING (event_type) GROUP BY 1),
e AS (SELECT event_type, sum(p * p) AS e FROM (SELECT event_type, sum(y) OVER (PARTITION BY event_type ORDER BY i) AS p FROM z) GROUP BY 1)
SELECT event_type, round(e / (n * n) / v, 5) AS kpss, lags::INTEGER AS lags FROM e JOIN v USING (event_type) JOIN g USING (event_type)""")
def kpss_by_type(t):
    return PN.kpss(_events(t), "value", KEY, ["event_type"]).select("event_type", F.round("kpss", 5).alias("kpss"), "lags")


@query("adf_by_type_lag0", "T-10", """
WITH d AS (SELECT event_type, value - lag(value) OVER w AS dy, lag(value) OVER w AS x FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
r AS (SELECT event_type, regr_slope(dy, x) AS b, regr_sxx(dy, x) AS sxx, regr_syy(dy, x) AS syy, regr_count(dy, x) AS n FROM d GROUP BY 1)
SELECT event_type, round(b / sqrt((syy - b * b * sxx) / (n - 2) / sxx), 5) AS adf FROM r""")
def adf_by_type(t):
    return PN.adf(_events(t), "value", KEY, ["event_type"], max_lag=0).select("event_type", F.round("adf", 5).alias("adf"))


@query("stationarity_by_type", "T-10")
def stationarity_by_type(t):
    return PN.stationarity(_events(t), "value", KEY, ["event_type"])


@query("partial_autocorrelation", "T-11")
def partial_autocorrelation(t):
    return T.autocorrelation(hourly(t), "value", ["ts"])


TRAIN = "o AS (SELECT value, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events), t AS (SELECT * FROM o WHERE i < floor(n * 0.8))"


@query("forecast_moving_average", "T-12", f"""
WITH {TRAIN}, l AS (SELECT value FROM t ORDER BY i DESC LIMIT 5), f AS (SELECT avg(value) AS f, stddev_samp(value) * 1.959963984540054 AS ci FROM l)
SELECT s::INTEGER AS step, round(f, 5) AS forecast, round(f - ci, 5) AS lower, round(f + ci, 5) AS upper FROM f, range(1, 11) r(s)""")
def forecast_moving_average(t):
    out, _ = FC.forecast(_events(t), "value", KEY, method="moving_average")
    return out.select("step", *[F.round(c, 5).alias(c) for c in ("forecast", "lower", "upper")])


@query("forecast_naive_scores", "T-12", f"""
WITH {TRAIN}, f AS (SELECT max_by(value, i) AS f FROM t), c AS (SELECT stddev_samp(value) * 1.959963984540054 AS ci FROM (SELECT value FROM t ORDER BY i DESC LIMIT 10))
SELECT round(avg(abs(value - f)), 5) AS mae, round(sqrt(avg((value - f) * (value - f))), 5) AS rmse, round(any_value(ci), 5) AS ci FROM o, f, c WHERE i >= floor(n * 0.8) AND i < floor(n * 0.8) + 10""")
def forecast_naive_scores(t):
    _, scores = FC.forecast(_events(t), "value", KEY, method="naive")
    return scores.select(*[F.round(c, 5).alias(c) for c in ("mae", "rmse", "ci")])


@query("forecast_naive_by_user", "T-12", """
WITH o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
t AS (SELECT * FROM o WHERE i < floor(n * 0.8)), f AS (SELECT user_id, max_by(value, i) AS f, max(i) AS m FROM t GROUP BY 1),
c AS (SELECT t.user_id, stddev_samp(value) * 1.959963984540054 AS ci FROM t JOIN f ON f.user_id = t.user_id AND i > m - 10 GROUP BY 1)
SELECT user_id, s::INTEGER AS step, round(f, 5) AS forecast, round(f - ci, 5) AS lower, round(f + ci, 5) AS upper FROM f JOIN c USING (user_id), range(1, 4) r(s)""")
def forecast_naive_by_user(t):
    out = PN.forecast(_events(t), "value", KEY, ["user_id"], steps=3, method="naive")
    return out.select("user_id", "step", *[F.round(c, 5).alias(c) for c in ("forecast", "lower", "upper")])


@query("forecast_smoothing_by_type", "T-12")
def forecast_smoothing_by_type(t):
    return PN.forecast(_events(t), "value", KEY, ["event_type"])


@query("forecast_smoothing", "T-12")
def forecast_smoothing(t):
    return FC.forecast(hourly(t), "value", ["ts"])[0]


@query("forecast_smoothing_seasonal", "T-12")
def forecast_smoothing_seasonal(t):
    return FC.forecast(hourly(t), "value", ["ts"], trend=True, period=24)[0]


def _with_null_type(t):
    """Events of which one type is unknown: a series of its own."""
    first = t.events.agg(F.min("event_type")).first()[0]
    return _events(t).withColumn("event_type", F.nullif(F.col("event_type"), F.lit(first)))


NULL_TYPE = "ev AS (SELECT event_id, ts, nullif(event_type, (SELECT min(event_type) FROM events)) AS event_type, value FROM events)"


@query("forecast_moving_average_by_type", "T-12", f"""
WITH {NULL_TYPE}, o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM ev),
t AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY i DESC) AS back FROM o WHERE i < floor(n * 0.8)),
f AS (SELECT event_type, avg(value) AS f, stddev_samp(value) * 1.959963984540054 AS ci FROM t WHERE back <= 5 GROUP BY 1)
SELECT event_type, s::INTEGER AS step, round(f, 5) AS forecast, round(f - ci, 5) AS lower, round(f + ci, 5) AS upper FROM f, range(1, 4) r(s)""")
def forecast_moving_average_by_type(t):
    out = PN.forecast(_with_null_type(t), "value", KEY, ["event_type"], steps=3, method="moving_average")
    return out.select("event_type", "step", *[F.round(c, 5).alias(c) for c in ("forecast", "lower", "upper")])


@query("resample_null_series", "T-2", f"WITH {NULL_TYPE} SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS ts, round(avg(value), 6) AS value FROM ev GROUP BY ALL")
def resample_null_series(t):
    return T.resample(_with_null_type(t), "ts", "value", "D", ["event_type"]).withColumn("value", F.round("value", 6))


@query("audit_windows_null_series", "T-6 T-8", f"""
WITH {NULL_TYPE}, b AS (SELECT event_type, min(ts) AS a, max(ts) AS z FROM ev GROUP BY 1), s AS (SELECT unnest(range(0, 100)) AS i),
w AS (SELECT event_type, a + to_days((i * 5)::INT) AS window_start, least(a + to_days((i * 5 + 10)::INT), z) AS window_end FROM s, b WHERE a + to_days((i * 5)::INT) <= z),
r AS (SELECT w.*, value FROM w JOIN ev e ON e.event_type IS NOT DISTINCT FROM w.event_type AND ts >= window_start AND ts < window_end)
SELECT event_type, window_start, window_end, count(*) AS count, round(avg(value), 6) AS mean, round(median(value), 6) AS median, count(DISTINCT value) AS unique_values
FROM r GROUP BY 1, 2, 3 HAVING count(*) >= 10""")
def audit_windows_null_series(t):
    out = T.audit_windows(_with_null_type(t), "ts", "value", window_days=10, series=["event_type"])
    return out.select("event_type", "window_start", "window_end", "count", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "unique_values")


@query("acf_null_series", "T-11", f"""
WITH {NULL_TYPE}, z AS (SELECT event_type, value - avg(value) OVER (PARTITION BY event_type) AS y, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM ev),
v AS (SELECT event_type, sum(y * y) AS v FROM z GROUP BY 1)
SELECT a.event_type, k::INTEGER AS lag, round(sum(a.y * b.y) / any_value(v), 6) AS acf FROM range(0, 11) r(k) JOIN z a ON true
JOIN z b ON b.event_type IS NOT DISTINCT FROM a.event_type AND b.i = a.i + k JOIN v ON v.event_type IS NOT DISTINCT FROM a.event_type GROUP BY 1, 2""")
def acf_null_series(t):
    return PN.autocorrelation(_with_null_type(t), "value", KEY, ["event_type"], lags=10).select("event_type", "lag", F.round("acf", 6).alias("acf"))


@query("segments_null_series", "T-5", f"""
WITH {NULL_TYPE}, o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM ev)
SELECT event_type, (i // 50 + 1)::BIGINT AS segment, min(ts) AS start, max(ts) AS "end", round(avg(value), 6) AS mean, count(*) AS samples FROM o GROUP BY 1, 2""")
def segments_null_series(t):
    df = _with_null_type(t)
    sizes = df.groupBy("event_type").count()
    marks = sizes.select("event_type", F.explode(F.expr("sequence(0L, count - 1, 50L)")).alias("position")).where("position > 0")
    out = CP.segments(df, "value", KEY, marks, ["event_type"])
    return out.select("event_type", "segment", "start", "end", F.round("mean", 6).alias("mean"), "samples")


def _smoothing_sql(alpha, beta, trend):
    return f"""
WITH RECURSIVE {HOURLY}, t AS (SELECT value AS y, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM h), tr AS (SELECT * FROM t WHERE i < floor(n * 0.8)),
b AS (SELECT min_by(y, i) AS y0, max_by(y, i) AS y1, count(*) AS n FROM tr),
r(i, l, s, se, sq) AS (SELECT 0::BIGINT, y0, {"(y1 - y0) / (n - 1)" if trend else "0.0::DOUBLE"}, 0.0::DOUBLE, 0.0::DOUBLE FROM b
 UNION ALL SELECT r.i + 1, l + s + {alpha} * (y - l - s), s + {alpha * beta} * (y - l - s), se + (y - l - s), sq + (y - l - s) * (y - l - s) FROM r JOIN tr ON tr.i = r.i),
z AS (SELECT l, s, sqrt(sq / n - (se / n) * (se / n)) * 1.959963984540054 AS ci FROM r, b WHERE r.i = b.n)
SELECT k::INTEGER AS step, round(l + k * s, 5) AS forecast, round(l + k * s - ci, 5) AS lower, round(l + k * s + ci, 5) AS upper FROM z, range(1, 11) u(k)"""


def _given(t, weights, trend):
    out = FC.forecast(hourly(t), "value", ["ts"], trend=trend, weights=weights)[0]
    return out.select("step", *[F.round(c, 5).alias(c) for c in ("forecast", "lower", "upper")])


@query("forecast_smoothing_given_weight", "T-12", _smoothing_sql(0.3, 0.0, False))
def forecast_smoothing_given_weight(t):
    return _given(t, (0.3,), False)


@query("forecast_trend_given_weights", "T-12", _smoothing_sql(0.2, 0.1, True))
def forecast_trend_given_weights(t):
    return _given(t, (0.2, 0.1), True)
