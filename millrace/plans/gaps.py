"""Queries over missing data and window operators."""

from pyspark.sql import functions as F

from millrace import ordered
from millrace.operators import missing as M
from millrace.plans.columns import HOLED_CUSTOMER, holed_customer
from millrace.plans.registry import query

WORDS = """(SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN '  ' WHEN 1 THEN 'nan' WHEN 2 THEN 'NULL' WHEN 3 THEN NULL ELSE c_name END AS c_name,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer)"""


def worded(t):
    return t.customer.selectExpr(
        "c_custkey", "CASE c_custkey % 9 WHEN 0 THEN '  ' WHEN 1 THEN 'nan' WHEN 2 THEN 'NULL' WHEN 3 THEN NULL ELSE c_name END AS c_name",
        "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal")


@query("missing_report", "M-1", f"""
SELECT 'c_name' AS "column", count_if(c_name IS NULL OR trim(c_name) IN ('', 'nan', 'NULL'))::BIGINT AS missing,
  round(count_if(c_name IS NULL OR trim(c_name) IN ('', 'nan', 'NULL')) * 100.0::DOUBLE / count(*), 2) AS pct FROM {WORDS}
UNION ALL SELECT 'c_acctbal', count(*) - count(c_acctbal), round((count(*) - count(c_acctbal)) * 100.0::DOUBLE / count(*), 2) FROM {WORDS}""")
def missing_report(t):
    return M.missing_report(worded(t))


@query("fill_replace", "M-2", f"SELECT c_custkey, coalesce(c_acctbal, 9999) AS c_acctbal FROM {HOLED_CUSTOMER}")
def fill_replace(t):
    return M.fix_missing(holed_customer(t).select("c_custkey", "c_acctbal"), "c_acctbal", "replace")[0]


@query("fill_custom_text", "M-3", f"""
SELECT c_custkey, CASE WHEN c_name IS NULL OR c_name = 'nan' THEN 'unknown' ELSE c_name END AS c_name FROM {WORDS}""")
def fill_custom_text(t):
    return M.fix_missing(worded(t).select("c_custkey", "c_name"), "c_name", "custom_text", "unknown")[0]


@query("fill_custom_number", "M-3", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 7 ELSE c_nationkey END AS c_nationkey FROM customer")
def fill_custom_number(t):
    df = t.customer.selectExpr("c_custkey", "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey")
    return M.fix_missing(df, "c_nationkey", "custom_number", 7.9)[0]


@query("fill_custom_date", "M-3", """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN TIMESTAMP '2000-01-01' ELSE o_orderdate END AS o_orderdate FROM orders""")
def fill_custom_date(t):
    df = t.orders.selectExpr("o_orderkey", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END AS o_orderdate")
    return M.fix_missing(df, "o_orderdate", "custom_date", "2000-01-01 00:00:00")[0]


@query("fill_mean", "M-4", f"""
SELECT c_custkey, round(coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM {HOLED_CUSTOMER})), 6) AS c_acctbal FROM {HOLED_CUSTOMER}""")
def fill_mean(t):
    out = M.fix_missing(holed_customer(t).select("c_custkey", "c_acctbal"), "c_acctbal", "mean")[0]
    return out.withColumn("c_acctbal", F.round("c_acctbal", 6))


@query("fill_median", "M-4", f"""
SELECT c_custkey, coalesce(c_acctbal, (SELECT median(c_acctbal) FROM {HOLED_CUSTOMER})) AS c_acctbal FROM {HOLED_CUSTOMER}""")
def fill_median(t):
    return M.fix_missing(holed_customer(t).select("c_custkey", "c_acctbal"), "c_acctbal", "median")[0]


HOLED_PART = "(SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_type END AS p_type, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size END AS p_size FROM part)"


def holed_part(t):
    return t.part.selectExpr("p_partkey", "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_type END AS p_type",
                             "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size END AS p_size")


def _mode(column, table):
    return f"(SELECT {column} FROM {table} WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query("fill_mode", "M-5", f"SELECT p_partkey, coalesce(p_type, {_mode('p_type', HOLED_PART)}) AS p_type, p_size FROM {HOLED_PART}")
def fill_mode(t):
    return M.fix_missing(holed_part(t), "p_type", "mode")[0]


GAPPY = """(SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 7 < 3 OR event_id < 10 THEN NULL ELSE value END AS value FROM events)"""


def gappy(t):
    return t.events.selectExpr("event_id", "ts", "user_id", "event_type",
                               "CASE WHEN event_id % 7 < 3 OR event_id < 10 THEN NULL ELSE value END AS value")


@query("fill_forward", "M-6 W-5", f"""
SELECT event_id, last_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id) AS value FROM {GAPPY}""")
def fill_forward(t):
    return M.fix_missing(gappy(t).select("event_id", "ts", "value"), "value", "ffill", order_by=["ts", "event_id"])[0].drop("ts")


@query("fill_backward_by_series", "M-6 W-5", f"""
SELECT event_id, user_id, first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM {GAPPY}""")
def fill_backward(t):
    return M.fill_along(gappy(t).select("event_id", "ts", "user_id", "value"), ["value"], "bfill", ["ts", "event_id"], ["user_id"]).drop("ts")


INTERPOLATED = f"""
WITH p AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS pos FROM {GAPPY}),
n AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER (ORDER BY pos) AS a0,
  last_value(value IGNORE NULLS) OVER (ORDER BY pos) AS v0,
  first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a1,
  first_value(value IGNORE NULLS) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1 FROM p)
SELECT event_id, round(CASE WHEN value IS NOT NULL THEN value WHEN v1 IS NULL THEN v0
  ELSE v0 + (v1 - v0) * (pos - a0) / nullif(a1 - a0, 0) END, 6) AS value FROM n"""


@query("interpolate_linear", "M-7 W-5", INTERPOLATED)
def interpolate_linear(t):
    out = M.interpolate(gappy(t).select("event_id", "ts", "value"), "value", ["ts", "event_id"])
    return out.select("event_id", F.round("value", 6).alias("value"))


@query("replace_missing_all_columns", "M-8", f"""
SELECT p_partkey, p_type, round(coalesce(p_size, (SELECT avg(p_size) FROM {HOLED_PART})), 6) AS p_size FROM {HOLED_PART}""")
def replace_missing_all(t):
    out = M.replace_missing(holed_part(t).withColumn("empty", F.lit(None).cast("string")), "mean")
    return out.withColumn("p_size", F.round("p_size", 6))


@query("replace_missing_mode", "M-8", f"""
SELECT p_partkey, coalesce(p_type, {_mode('p_type', HOLED_PART)}) AS p_type, coalesce(p_size, {_mode('p_size', HOLED_PART)}) AS p_size FROM {HOLED_PART}""")
def replace_missing_mode(t):
    return M.replace_missing(holed_part(t), "mode")


@query("fill_all_one_value", "M-9", f"""
SELECT p_partkey::VARCHAR AS p_partkey, coalesce(p_type, 'NoData') AS p_type, coalesce(p_size::VARCHAR, 'NoData') AS p_size FROM {HOLED_PART}""")
def fill_all(t):
    return M.fill_all(holed_part(t), "NoData")


@query("predict_from_position", "M-10")
def predict_from_position(t):
    df = t.orders.selectExpr("o_orderkey", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice")
    return M.predict_from_position(df, "o_totalprice", ["o_orderkey"], trees=5, depth=5)


@query("knn_impute", "M-11", """
WITH a AS (SELECT s_suppkey AS k, s_nationkey::DOUBLE AS x, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_acctbal END AS y FROM supplier),
d AS (SELECT g.k, g.x, n.y, row_number() OVER (PARTITION BY g.k ORDER BY (g.x - n.x) * (g.x - n.x), n.k) AS r
  FROM a g JOIN a n ON n.y IS NOT NULL WHERE g.y IS NULL)
SELECT k, x, round(avg(y), 6) AS y FROM d WHERE r <= 5 GROUP BY k, x UNION ALL SELECT k, x, round(y, 6) FROM a WHERE y IS NOT NULL""")
def knn_impute(t):
    df = t.supplier.selectExpr("s_suppkey AS k", "double(s_nationkey) AS x", "CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_acctbal END AS y")
    return M.knn_impute(df, ["x", "y"], ["k"]).withColumn("y", F.round("y", 6))


GAPPY = """a AS (SELECT vec_id AS k, CASE WHEN vec_id % 11 = 0 THEN NULL ELSE embedding[1]::DOUBLE END AS a, CASE WHEN vec_id % 13 = 0 THEN NULL ELSE embedding[2]::DOUBLE END AS b, embedding[3]::DOUBLE AS c FROM embeddings)"""


def _imputed(target, other):
    return f"""(SELECT k, avg({target}) AS v FROM (SELECT g.k, n.{target}, row_number() OVER (PARTITION BY g.k ORDER BY
  (coalesce((g.{other} - n.{other}) * (g.{other} - n.{other}), 0) + (g.c - n.c) * (g.c - n.c)) * (3.0 / (1 + (g.{other} - n.{other} IS NOT NULL)::INT)), n.k) AS r
  FROM a g JOIN a n ON n.{target} IS NOT NULL WHERE g.{target} IS NULL) WHERE r <= 5 GROUP BY k)"""


@query("knn_impute_with_gaps", "M-11 F-5", f"""
WITH {GAPPY}, x AS {_imputed("a", "b")}, y AS {_imputed("b", "a")}
SELECT a.k, round(coalesce(a.a, x.v), 6) AS a, round(coalesce(a.b, y.v), 6) AS b, round(c, 6) AS c FROM a LEFT JOIN x ON x.k = a.k LEFT JOIN y ON y.k = a.k""")
def knn_impute_with_gaps(t):
    df = t.embeddings.selectExpr("vec_id AS k", "IF(vec_id % 11 = 0, NULL, double(embedding[0])) AS a", "IF(vec_id % 13 = 0, NULL, double(embedding[1])) AS b",
                                 "double(embedding[2]) AS c")
    return M.knn_impute(df, ["a", "b", "c"], ["k"]).withColumns({c: F.round(c, 6) for c in "abc"})


@query("apply_suggestions", "M-12 J-5", """
SELECT p_partkey, CASE WHEN p_partkey % 35 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part""")
def apply_suggestions(t):
    hints = t.part.selectExpr("p_partkey", "IF(p_partkey % 7 = 0, 'many', string(p_size + 1)) AS value")
    return M.apply_suggestions(holed_part(t).select("p_partkey", "p_size"), "p_size", hints, ["p_partkey"])


@query("fill_by_context_mean", "M-12", f"""
SELECT c_custkey, round(coalesce(c_acctbal, avg(c_acctbal) OVER (PARTITION BY c_mktsegment, c_nationkey),
  (SELECT avg(c_acctbal) FROM {HOLED_CUSTOMER})), 6) AS c_acctbal FROM {HOLED_CUSTOMER}""")
def fill_by_context_mean(t):
    out = M.fill_by_context(holed_customer(t), "c_acctbal", ["c_mktsegment", "c_nationkey"])
    return out.select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"))


@query("fill_by_context_mode", "M-12", """
WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_type END AS p_type FROM part),
m AS (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS r FROM p WHERE p_type IS NOT NULL GROUP BY 1, 2)
SELECT p_partkey, coalesce(p.p_type, m.p_type) AS p_type FROM p LEFT JOIN m ON m.p_brand = p.p_brand AND m.r = 1""")
def fill_by_context_mode(t):
    df = t.part.selectExpr("p_partkey", "p_brand", "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_type END AS p_type")
    return M.fill_by_context(df, "p_type", ["p_brand"]).drop("p_brand")


@query("row_context", "M-13", """
WITH p AS (SELECT p_partkey, p_size, p_type, lag(p_type, 2) OVER w a, lag(p_type, 1) OVER w b, lead(p_type, 1) OVER w c, lead(p_type, 2) OVER w d
  FROM part WINDOW w AS (ORDER BY p_partkey))
SELECT p_partkey, p_type, concat_ws('|', a, b, c, d) AS near FROM p WHERE p_partkey % 5 = 0""")
def row_context(t):
    df = t.part.selectExpr("p_partkey", "p_type", "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size END AS p_size")
    out = M.row_context(df, "p_size", ["p_type"], ["p_partkey"])
    return out.select("p_partkey", "p_type", F.array_join("neighbours.p_type", "|").alias("near"))


@query("choose_imputation", "M-14", f"""
SELECT 'c_custkey' AS "column", 0.0::DOUBLE AS missing_ratio, 'none' AS method FROM region WHERE r_regionkey = 0
UNION ALL SELECT 'c_acctbal', (count(*) - count(c_acctbal))::DOUBLE / count(*), 'mean' FROM {WORDS}
UNION ALL SELECT 'c_name', (count(*) - count(c_name))::DOUBLE / count(*), 'mode' FROM {WORDS}""")
def choose_imputation(t):
    return M.choose_imputation(worded(t))


@query("drop_missing_rows", "M-15", f"SELECT c_custkey, c_acctbal FROM {HOLED_CUSTOMER} WHERE c_acctbal IS NOT NULL")
def drop_missing_rows(t):
    return M.drop_missing(holed_customer(t).select("c_custkey", "c_acctbal"), "c_acctbal")


@query("completeness_ratio", "M-16", f"SELECT (4 * count(*) + count(c_acctbal))::DOUBLE / (5 * count(*)) AS completeness FROM {HOLED_CUSTOMER}")
def completeness_ratio(t):
    return M.completeness(holed_customer(t))


@query("lag_pairs_last_500", "W-1", """
SELECT event_id, value, lag(value) OVER (ORDER BY ts, event_id) AS before FROM events ORDER BY ts DESC, event_id DESC LIMIT 500""")
def lag_pairs(t):
    df = t.events.select("event_id", "ts", "value")
    out = ordered.framed(df, ["ts", "event_id"], lambda w: {"before": F.lag("value").over(w)}, before=1)
    return out.orderBy(F.desc("ts"), F.desc("event_id")).limit(500).drop("ts")


@query("shift_by_five", "W-2", "SELECT event_id, lag(value, 5) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS shifted FROM events")
def shift_by_five(t):
    df = t.events.select("event_id", "ts", "user_id", "value")
    out = ordered.framed(df, ["ts", "event_id"], lambda w: {"shifted": F.lag("value", 5).over(w)}, before=5, series=["user_id"])
    return out.select("event_id", "shifted")


@query("rolling_mean_full", "W-4 T-3", """
SELECT event_id, round(CASE WHEN count(value) OVER w = 5 THEN avg(value) OVER w END, 6) AS mean FROM events
WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def rolling_mean_full(t):
    from millrace.operators.timeseries import rolling_mean
    out = rolling_mean(t.events.select("event_id", "ts", "value"), "value", 5, ["ts", "event_id"], name="mean")
    return out.select("event_id", F.round("mean", 6).alias("mean"))


@query("rolling_mean_partial", "W-4", """
SELECT event_id, round(avg(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS mean FROM events""")
def rolling_mean_partial(t):
    from millrace.operators.timeseries import rolling_mean
    out = rolling_mean(t.events.select("event_id", "ts", "value"), "value", 3, ["ts", "event_id"], min_rows=1, name="mean")
    return out.select("event_id", F.round("mean", 6).alias("mean"))


@query("top_by_value", "W-6", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def top_by_value(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5)


@query("sort_rows", "W-7", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal")
def sort_rows(t):
    return t.supplier.select("s_suppkey", "s_acctbal").orderBy("s_acctbal")
