"""Queries over profiles, summaries, correlations and chart aggregates."""

from pyspark.sql import functions as F

from millrace.operators import missing as M
from millrace.operators import profile as P
from millrace.plans.columns import HOLED_CUSTOMER, holed_customer
from millrace.plans.registry import query


def _profile_sql(table, columns):
    return " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count(*) AS count, count(*) - count({c}) AS missing, count_if({c} = 0)::BIGINT AS zeroes,
  max({c})::DOUBLE AS max, min({c})::DOUBLE AS min, quantile_cont({c}::DOUBLE, 0.05) AS q05, quantile_cont({c}::DOUBLE, 0.25) AS q25,
  quantile_cont({c}::DOUBLE, 0.5) AS q50, quantile_cont({c}::DOUBLE, 0.75) AS q75, quantile_cont({c}::DOUBLE, 0.95) AS q95,
  (max({c}) - min({c}))::DOUBLE AS rng, round(quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25), 6) AS iqr,
  round(avg({c}), 5) AS avg, round(stddev_samp({c}), 6) AS std, round(var_samp({c}), 3) AS var, round(kurtosis({c}), 6) AS kurt,
  round(skewness({c}), 6) AS skew, round(sum({c}::DOUBLE), 2) AS sum, count(DISTINCT {c}) AS distinct,
  count(*) - count(DISTINCT {c}) AS duplicates FROM {table}""" for c in columns)


def _rounded(df):
    return df.withColumns({
        "iqr": F.round("iqr", 6), "avg": F.round("avg", 5), "std": F.round("std", 6), "var": F.round("var", 3),
        "kurt": F.round("kurt", 6), "skew": F.round("skew", 6), "sum": F.round("sum", 2),
    })


FILLED = f"""(SELECT coalesce(c_acctbal, (SELECT median(c_acctbal) FROM {HOLED_CUSTOMER})) AS c_acctbal FROM {HOLED_CUSTOMER})"""


@query("flagship_fill_and_profile", "A-1 M-4", _profile_sql(FILLED, ["c_acctbal"]))
def flagship(t):
    filled, _ = M.fix_missing(holed_customer(t), "c_acctbal", "median")
    return _rounded(P.profile_numeric(filled, ["c_acctbal"]))


LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query("profile_numeric", "A-1", _profile_sql("lineitem", LINE_NUMBERS))
def profile_numeric(t):
    return _rounded(P.profile_numeric(t.lineitem, LINE_NUMBERS))


@query("profile_with_missing", "A-1", _profile_sql(HOLED_CUSTOMER, ["c_acctbal", "c_nationkey"]))
def profile_with_missing(t):
    return _rounded(P.profile_numeric(holed_customer(t), ["c_acctbal", "c_nationkey"]))


def _dates_sql(c, table, pattern, part, iqr):
    q = lambda p: f"strftime(make_timestamp(quantile_cont(epoch_us({c})::DOUBLE, {p})::BIGINT), '{pattern}')"
    return f"""SELECT '{c}' AS "column", count(*) AS count, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS distinct,
  count(*) - count(DISTINCT {c}) AS duplicates, strftime(max({c}), '{pattern}') AS max, strftime(min({c}), '{pattern}') AS min,
  ((epoch_us(max({c})) - epoch_us(min({c}))) // 86400000000)::BIGINT AS rng, round(avg({part}), 6) AS avg, round(stddev_samp({part}), 6) AS std,
  round(var_samp({part}), 6) AS var, round(kurtosis({part}), 6) AS kurt, round(skewness({part}), 6) AS skew, {iqr} AS iqr,
  {q(0.05)} AS q05, {q(0.25)} AS q25, {q(0.5)} AS q50, {q(0.75)} AS q75, {q(0.95)} AS q95 FROM {table}"""


def _dates_rounded(df):
    return df.withColumns({n: F.round(n, 6) for n in ("avg", "std", "var", "kurt", "skew", "iqr")})


@query("profile_dates", "A-2", _dates_sql(
    "o_orderdate", "orders", "%Y-%m-%d", "year(o_orderdate)::DOUBLE",
    "floor((quantile_cont(epoch_us(o_orderdate)::DOUBLE, 0.75) - quantile_cont(epoch_us(o_orderdate)::DOUBLE, 0.25)) / 86400000000)"))
def profile_dates(t):
    return _dates_rounded(P.profile_dates(t.orders, "o_orderdate"))


@query("profile_times", "A-2", _dates_sql(
    "ts", "(SELECT date_trunc('second', ts) AS ts FROM events)", "%Y-%m-%d %H:%M:%S", "(hour(ts) + minute(ts) / 60.0)",
    "round((quantile_cont(epoch_us(ts)::DOUBLE, 0.75) - quantile_cont(epoch_us(ts)::DOUBLE, 0.25)) / 3600000000.0, 6)"))
def profile_times(t):
    texts = t.events.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))
    if not P.is_date_column(texts, "ts"):
        raise AssertionError("ts should be found to be a date")
    return _dates_rounded(P.profile_dates(texts, "ts"))


@query("table_summary", "A-3", """
SELECT (SELECT count(*) FROM documents) AS "rows",
  CAST((SELECT sum(n - 1) FROM (SELECT count(*) n FROM documents GROUP BY text, lang, source, n_chars)) AS BIGINT) AS duplicate_rows,
  4 AS features, 1 AS numerical, 2 AS categorical, 1 AS text FROM documents LIMIT 1""")
def table_summary(t):
    return P.table_summary(t.documents.drop("doc_id"))


@query("describe_numeric", "A-4", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min,
  quantile_cont({c}::DOUBLE, 0.25) AS p25, quantile_cont({c}::DOUBLE, 0.5) AS p50, quantile_cont({c}::DOUBLE, 0.75) AS p75,
  max({c})::DOUBLE AS max FROM part""" for c in ("p_size", "p_retailprice")))
def describe_numeric(t):
    out = P.describe(t.part, ["p_size", "p_retailprice"])
    return out.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("missing_share", "A-5", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count(*) - count({c}) AS missing, (count(*) - count({c})) * 100.0::DOUBLE / count(*) AS missing_pct
FROM {HOLED_CUSTOMER}""" for c in "c_custkey c_name c_nationkey c_acctbal c_mktsegment".split()))
def missing_share(t):
    return P.missing_share(holed_customer(t))


@query("column_info", "A-6", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", '{k}' AS dtype, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS distinct FROM {HOLED_CUSTOMER}"""
    for c, k in {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}.items()))
def column_info(t):
    return P.column_info(holed_customer(t).select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))


@query("distinct_values", "A-7", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_values, string_agg(DISTINCT {c}, ', ' ORDER BY {c}) AS values FROM orders"""
    for c in ("o_orderstatus", "o_orderpriority")))
def distinct_values(t):
    return P.distinct_values(t.orders, ["o_orderstatus", "o_orderpriority"])


@query("distinct_value_rows", "A-7", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {c}::VARCHAR AS value, count(*) AS n FROM orders WHERE {c} IS NOT NULL GROUP BY {c}"
    for c in ("o_orderstatus", "o_custkey")))
def distinct_value_rows(t):
    return P.distinct_value_rows(t.orders, ["o_orderstatus", "o_custkey"])


@query("dataset_summary", "A-8", f"""
SELECT count(*) AS "rows", 5 AS columns, 3 AS numeric_columns, 2 AS categorical_columns, 0 AS datetime_columns,
  count(*) - count(c_acctbal) AS missing, (count(*) - count(c_acctbal)) * 100.0::DOUBLE / (count(*) * 5) AS missing_pct,
  CAST(0 AS BIGINT) AS duplicates FROM {HOLED_CUSTOMER}""")
def dataset_summary(t):
    return P.dataset_summary(holed_customer(t))


@query("dataset_sample_rows", "A-8", "SELECT * FROM supplier ORDER BY s_suppkey LIMIT 3")
def dataset_sample_rows(t):
    return t.supplier.orderBy("s_suppkey").limit(3)


@query("analyze_numeric_column", "A-9", f"""
SELECT 'c_acctbal' AS "column", count(DISTINCT c_acctbal) AS "unique", count(*) - count(c_acctbal) AS missing,
  (count(*) - count(c_acctbal)) * 100.0::DOUBLE / count(*) AS missing_pct, min(c_acctbal) AS min, max(c_acctbal) AS max,
  round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS std, median(c_acctbal) AS median FROM {HOLED_CUSTOMER}""")
def analyze_numeric_column(t):
    out = P.analyze_column(holed_customer(t), "c_acctbal")
    return out.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("analyze_top_values", "A-9 W-6", """
SELECT p_brand AS value, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, value LIMIT 5""")
def analyze_top_values(t):
    return P.top_values(t.part, "p_brand")


SPARSE = "(SELECT c_custkey, c_nationkey, c_acctbal * 2 AS twice, c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS alias, c_custkey % 2 AS odd FROM customer)"


@query("find_insights", "A-10", f"""
SELECT 'correlation' AS kind, 'twice ~ c_acctbal' AS subject, round(corr(twice, c_acctbal), 6) AS amount FROM {SPARSE}
UNION ALL SELECT 'missing', 'alias', round((count(*) - count(alias)) * 100.0::DOUBLE / count(*), 6) FROM {SPARSE}
UNION ALL SELECT 'binary', 'odd', 2.0 FROM region WHERE r_regionkey = 0""")
def find_insights(t):
    df = t.customer.selectExpr("c_custkey", "c_nationkey", "c_acctbal * 2 AS twice", "c_acctbal",
                               "CASE WHEN c_custkey % 3 = 0 THEN c_name END AS alias", "c_custkey % 2 AS odd")
    return P.insights(df).withColumn("amount", F.round("amount", 6))


@query("answer_missing", "A-11", f"SELECT count(*) - count(c_acctbal) AS answer FROM {HOLED_CUSTOMER}")
def answer_missing(t):
    return P.answer(holed_customer(t), "missing")


@query("answer_duplicates", "A-11", "SELECT CAST(sum(n - 1) AS BIGINT) AS answer FROM (SELECT count(*) n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def answer_duplicates(t):
    return P.answer(t.lineitem.select("l_orderkey", "l_linenumber"), "duplicates")


@query("answer_rows", "A-11", "SELECT count(*) AS answer FROM lineitem")
def answer_rows(t):
    return P.answer(t.lineitem, "rows")


@query("answer_columns", "A-11", "SELECT count(*) AS answer FROM (DESCRIBE lineitem)")
def answer_columns(t):
    return P.answer(t.lineitem, "columns")


CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CORR_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem"
    for i, a in enumerate(CORR) for b in CORR[i + 1:])


@query("correlation_matrix", "A-12", CORR_SQL)
def correlation_matrix(t):
    return P.correlations(t.lineitem, CORR).withColumn("r", F.round("r", 6))


@query("high_correlations", "A-12", "SELECT 'p_partkey' AS a, 'twice' AS b, round(corr(p_partkey, p_partkey * 2 + p_size), 6) AS r FROM part")
def high_correlations(t):
    df = t.part.selectExpr("p_partkey", "p_partkey * 2 + p_size AS twice", "p_size")
    return P.high_correlations(df, 0.9).withColumn("r", F.round("r", 6))


@query("crosstab_top_pairs", "A-13", """
SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL ORDER BY n DESC, 1, 2 LIMIT 5""")
def crosstab_top_pairs(t):
    return P.crosstab_top(t.lineitem, "l_returnflag", "l_linestatus")


@query("group_sum", "A-14 W-7", "SELECT c_mktsegment, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def group_sum(t):
    return P.group_sum(t.customer, "c_mktsegment", "c_acctbal").withColumn("total", F.round("total", 2))


@query("context_analysis", "A-15", " UNION ALL ".join(f"""
SELECT '{c}' AS context, round(corr(l_extendedprice, {c}), 6) AS r, CASE WHEN abs(corr(l_extendedprice, {c})) > 0.7 THEN 'strong'
  WHEN abs(corr(l_extendedprice, {c})) > 0.3 THEN 'moderate' ELSE 'weak' END AS strength FROM lineitem""" for c in ("l_quantity", "l_tax")))
def context_analysis(t):
    return P.context_analysis(t.lineitem, "l_extendedprice", ["l_quantity", "l_tax"]).withColumn("r", F.round("r", 6))


@query("path_sums", "A-16", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS total, grouping_id(l_returnflag, l_linestatus) AS level
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def path_sums(t):
    return P.path_sums(t.lineitem, ["l_returnflag", "l_linestatus"], "l_quantity").withColumn("total", F.round("total", 2))


@query("histogram_bins", "A-16", """
WITH e AS (SELECT min(o_totalprice) lo, (max(o_totalprice) - min(o_totalprice)) / 10 w FROM orders)
SELECT CAST(least(floor((o_totalprice - lo) / w), 9) AS INTEGER) AS bin, count(*) AS n FROM orders, e GROUP BY 1""")
def histogram_bins(t):
    return P.histogram(t.orders, "o_totalprice").select("bin", "n")


@query("density_heatmap", "A-16", """
WITH e AS (SELECT min(l_quantity) la, (max(l_quantity) - min(l_quantity)) / 10 wa, min(l_tax) lb, (max(l_tax) - min(l_tax)) / 10 wb FROM lineitem)
SELECT CAST(least(floor((l_quantity - la) / wa), 9) AS INTEGER) AS a_bin, CAST(least(floor((l_tax - lb) / wb), 9) AS INTEGER) AS b_bin,
  count(*) AS n FROM lineitem, e GROUP BY 1, 2""")
def density_heatmap(t):
    return P.heatmap(t.lineitem, "l_quantity", "l_tax")


@query("null_mask_counts", "A-17", f"""
SELECT 'c_acctbal' AS variable, c_acctbal IS NULL AS missing, count(*) AS n FROM {HOLED_CUSTOMER} GROUP BY ALL
UNION ALL SELECT 'c_name', false, count(*) FROM customer""")
def null_mask_counts(t):
    return P.null_mask_counts(holed_customer(t).select("c_acctbal", "c_name"))


@query("dtype_groups", "A-18", """
SELECT CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' ELSE lower(column_type) END AS dtype,
  string_agg(column_name, ',') AS columns, count(*) AS n FROM (DESCRIBE customer) GROUP BY 1""")
def dtype_groups(t):
    return P.dtype_groups(t.customer)


@query("numeric_like_columns", "A-19", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(try_cast({c} AS DOUBLE)) AS parsed FROM customer"""
    for c in ("c_custkey", "c_nationkey", "c_acctbal")))
def numeric_like_columns(t):
    return P.numeric_like(t.customer)


@query("box_statistics", "A-20", """
SELECT l_returnflag, min(l_extendedprice) AS min, quantile_cont(l_extendedprice, 0.25) AS q25, quantile_cont(l_extendedprice, 0.5) AS q50,
  quantile_cont(l_extendedprice, 0.75) AS q75, max(l_extendedprice) AS max, count(*) AS n FROM lineitem GROUP BY 1""")
def box_statistics(t):
    return P.box_stats(t.lineitem, "l_returnflag", "l_extendedprice")
