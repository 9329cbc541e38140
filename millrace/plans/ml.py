"""Queries over encoders, feature selection and preparation for training."""

from pyspark.sql import functions as F

from millrace.operators import encode as E
from millrace.operators import mlprep as L
from millrace.plans.registry import query


@query("data_characteristics", "B-1", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count_if({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) > 0.05 * count(*) AS outliers, round(skewness({c}), 6) AS skew,
  CASE WHEN abs(skewness({c})) < 0.5 THEN 'normal' WHEN abs(skewness({c})) > 1 THEN 'skewed' ELSE 'neither' END AS shape,
  count_if({c} < 0) > 0 AS has_negative, count_if({c} = 0) > 0 AS has_zero, count_if({c} = 0) > 0.9 * count(*) AS sparse
FROM {t}, (SELECT quantile_cont({c}, 0.25) q1, quantile_cont({c}, 0.75) q3 FROM {t})""" for c, t in
    (("c_acctbal", "customer"), ("c_nationkey", "customer"))))
def data_characteristics(t):
    return L.data_characteristics(t.customer, ["c_acctbal", "c_nationkey"]).withColumn("skew", F.round("skew", 6))


@query("recommend_scaling", "B-1", """
SELECT unnest(['mean_normalisation', 'robust_scaler', 'standard_scaler', 'yeo_johnson']) AS method FROM customer GROUP BY 1 HAVING count_if(c_acctbal < 0) > 0""")
def recommend_scaling(t):
    return L.recommend_scaling(t.customer, ["c_acctbal", "c_nationkey"])


@query("selection_advice", "B-2", """
SELECT true AS recommended, 'low' AS confidence, CAST(3 AS BIGINT) AS suggested_k, count(*)::DOUBLE / 5 AS ratio, CAST(1 AS BIGINT) AS constant_features,
  CAST(0 AS BIGINT) AS correlated_pairs FROM part""")
def selection_advice(t):
    df = t.part.selectExpr("p_partkey", "p_size", "pmod(p_size * 7919, 13) AS mix", "p_name", "1 AS one")
    return L.selection_advice(df, target="p_partkey")


@query("ml_issues", "B-3", """
WITH d AS (SELECT p_name, CASE WHEN p_partkey % 2 = 0 THEN 'even' ELSE 'odd' END AS parity, 1 AS one, p_size, p_size * 2 + 1 AS twice,
  CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END AS half FROM part)
SELECT CASE WHEN count(DISTINCT p_name) > 50 THEN 'high_cardinality' ELSE 'one_hot' END AS kind, 'p_name' AS subject, count(DISTINCT p_name)::DOUBLE AS amount FROM d
UNION ALL SELECT 'binary', 'parity', 2.0 FROM region WHERE r_regionkey = 0 UNION ALL SELECT 'constant', 'one', 1.0 FROM region WHERE r_regionkey = 0
UNION ALL SELECT 'high_missing', 'half', (count(*) - count(half)) * 100.0::DOUBLE / count(*) FROM d
UNION ALL SELECT 'correlated', 'p_size ~ twice', round(corr(p_size, twice), 6) FROM d""")
def ml_issues(t):
    df = t.part.selectExpr("p_name", "IF(p_partkey % 2 = 0, 'even', 'odd') AS parity", "1 AS one", "p_size",
                           "p_size * 2 + 1 AS twice", "IF(p_partkey % 2 = 0, p_retailprice, NULL) AS half")
    return L.ml_issues(df).withColumn("amount", F.round("amount", 6))


PREPARED = """
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_type END AS p_type, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size END AS p_size FROM part),
f AS (SELECT p_partkey, coalesce(p_type, 'missing') AS p_type, coalesce(p_size, (SELECT median(p_size) FROM p)) AS p_size FROM p)
"""


@query("prepare_for_ml_label", "B-5", PREPARED + """
SELECT p_partkey, (SELECT count(DISTINCT g.p_type) FROM f g WHERE g.p_type < f.p_type) AS p_type,
  round((p_size - (SELECT avg(p_size) FROM f)) / (SELECT stddev_pop(p_size) FROM f), 6) AS p_size FROM f""")
def prepare_for_ml_label(t):
    from millrace.plans.gaps import holed_part
    out, _ = L.prepare_for_ml(holed_part(t), "standard_scaler", "label", target="p_partkey")
    return out.withColumn("p_size", F.round("p_size", 6))


@query("prepare_for_ml_onehot", "B-5 E-1", PREPARED + """
SELECT p_partkey, round((p_size - (SELECT min(p_size) FROM f)) / (SELECT max(p_size) - min(p_size) FROM f), 6) AS p_size,
  (p_type = 'missing')::INTEGER AS p_type_missing, (p_type = 'SMALL')::INTEGER AS "p_type_SMALL" FROM f""")
def prepare_for_ml_onehot(t):
    from millrace.plans.gaps import holed_part
    out, _ = L.prepare_for_ml(holed_part(t), "minmax_scaler", "onehot", target="p_partkey")
    return out.select("p_partkey", F.round("p_size", 6).alias("p_size"), "p_type_missing", "p_type_SMALL")


@query("one_hot_columns", "E-1", """
SELECT o_orderkey, (o_orderstatus = 'F')::INTEGER AS "o_orderstatus_F", (o_orderstatus = 'O')::INTEGER AS "o_orderstatus_O",
  (o_orderstatus = 'P')::INTEGER AS "o_orderstatus_P" FROM orders""")
def one_hot_columns(t):
    return E.one_hot(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus")


@query("one_hot_vector", "E-1", "SELECT o_orderkey, list_position(['F', 'O', 'P'], o_orderstatus)::BIGINT - 1 AS hot FROM orders")
def one_hot_vector(t):
    from pyspark.ml.functions import vector_to_array
    out, _ = E.one_hot_vector(t.orders.select("o_orderkey", "o_orderstatus"), ["o_orderstatus"])
    return out.select("o_orderkey", (F.array_position(vector_to_array("o_orderstatus_vec"), 1.0) - 1).alias("hot"))


@query("label_encode", "E-2", """
SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN -1 ELSE dense_rank() OVER (PARTITION BY c_custkey % 7 = 0 ORDER BY c_mktsegment) - 1 END AS code FROM customer""")
def label_encode(t):
    df = t.customer.selectExpr("c_custkey", "IF(c_custkey % 7 = 0, NULL, c_mktsegment) AS seg")
    return E.label_encode(df, "seg", "code").drop("seg")


@query("target_encode", "E-3", """
SELECT c_custkey, round((sum(c_acctbal) OVER w + 10 * (SELECT avg(c_acctbal) FROM customer)) / (count(*) OVER w + 10), 6) AS enc
FROM customer WINDOW w AS (PARTITION BY c_mktsegment)""")
def target_encode(t):
    return E.target_encode(t.customer, "c_mktsegment", "c_acctbal", output="enc").select("c_custkey", F.round("enc", 6).alias("enc"))


@query("frequency_encode", "E-4", "SELECT l_orderkey, l_linenumber, l_quantity, count(*) OVER (PARTITION BY l_returnflag) AS freq FROM lineitem")
def frequency_encode(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    return E.frequency_encode(df, "l_returnflag", output="freq").drop("l_returnflag")


@query("binary_encode", "E-4", """
SELECT c_custkey, (r // 4) % 2 AS c_mktsegment_bit2, (r // 2) % 2 AS c_mktsegment_bit1, r % 2 AS c_mktsegment_bit0
FROM (SELECT c_custkey, (dense_rank() OVER (ORDER BY c_mktsegment))::INTEGER AS r FROM customer)""")
def binary_encode(t):
    return E.binary_encode(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment").drop("c_mktsegment")


@query("polynomial_features", "E-5", """
SELECT p_partkey, p_size * p_size AS p_size_x_p_size, p_size * p_retailprice AS p_size_x_p_retailprice,
  p_retailprice * p_retailprice AS p_retailprice_x_p_retailprice FROM part""")
def polynomial_features(t):
    out = E.polynomial_features(t.part.select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])
    return out.drop("p_size", "p_retailprice")


@query("interaction_terms", "E-5", "SELECT p_partkey, p_size, p_retailprice, p_size * p_retailprice AS p_size_x_p_retailprice FROM part")
def interaction_terms(t):
    return E.interaction_terms(t.part.select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])


@query("bin_equal_width", "E-6", """
WITH e AS (SELECT min(l_quantity) lo, max(l_quantity) - min(l_quantity) w FROM lineitem)
SELECT l_orderkey, l_quantity, CAST(CASE WHEN l_quantity = lo THEN 0 ELSE ceil((l_quantity - lo) / w * 5) - 1 END AS INTEGER) AS bin FROM lineitem, e""")
def bin_equal_width(t):
    return E.bin_equal_width(t.lineitem.select("l_orderkey", "l_quantity"), "l_quantity", output="bin")


@query("bin_quantile", "E-6 2.9 pandas", """
SELECT o_orderkey, (o_totalprice > a)::INTEGER + (o_totalprice > b)::INTEGER + (o_totalprice > c)::INTEGER AS bin FROM orders,
  (SELECT quantile_cont(o_totalprice, 0.25) a, quantile_cont(o_totalprice, 0.5) b, quantile_cont(o_totalprice, 0.75) c FROM orders)""")
def bin_quantile(t):
    return E.bin_quantile(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", output="bin").drop("o_totalprice")


NUM = ["l_quantity", "l_discount", "l_tax"]


@query("select_f_regression", "E-7", " UNION ALL ".join(f"""
SELECT '{c}' AS feature, round(pow(corr({c}, l_extendedprice), 2) / (1 - pow(corr({c}, l_extendedprice), 2)) * (count(*) - 2), 4) AS score FROM lineitem""" for c in NUM))
def select_f_regression(t):
    return E.f_regression(t.lineitem, NUM, "l_extendedprice").withColumn("score", F.round("score", 4))


@query("select_f_classif", "E-7", " UNION ALL ".join(f"""
SELECT '{c}' AS feature, round((sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))), 4) AS score
FROM (SELECT count(*) n, avg({c}) m, var_pop({c}) v FROM lineitem GROUP BY l_returnflag), (SELECT avg({c}) g FROM lineitem)""" for c in NUM))
def select_f_classif(t):
    return E.f_classif(t.lineitem, NUM, "l_returnflag").withColumn("score", F.round("score", 4))


@query("select_k_by_variance", "E-7", "SELECT l_orderkey, l_quantity FROM lineitem")
def select_k_by_variance(t):
    return E.select_k_best(t.lineitem.select("l_orderkey", *NUM), NUM, 1)[0]


@query("drop_low_variance", "E-8", "SELECT p_partkey, p_size FROM part")
def drop_low_variance(t):
    return E.drop_low_variance(t.part.selectExpr("p_partkey", "p_size", "5 AS five"), ["p_size", "five"])


@query("drop_correlated", "E-8", "SELECT p_partkey, p_size FROM part")
def drop_correlated(t):
    df = t.part.selectExpr("p_partkey", "p_size", "p_size * 2 AS twice", "p_size + 0.01 * p_retailprice / 2000 AS near")
    return E.drop_correlated(df, ["p_size", "twice", "near"])


@query("linear_regression", "L-1", """
WITH s AS (SELECT l_quantity x, l_extendedprice y, ('0x' || substr(md5(l_orderkey || '|' || l_partkey || '|' || l_linenumber || '|42'), 1, 6))::INT % 100 AS slot FROM lineitem),
m AS (SELECT regr_slope(y, x) a, regr_intercept(y, x) b FROM s WHERE slot < 80)
SELECT round(avg((y - b - a * x) * (y - b - a * x)) / 1e6, 4) AS mse, round(any_value(b), 4) AS intercept, round(any_value(a), 4) AS coef_l_quantity
FROM s, m WHERE slot >= 80""")
def linear_regression(t):
    out = L.fit_linear(t.lineitem, "l_extendedprice", ["l_quantity"], ["l_orderkey", "l_partkey", "l_linenumber"])
    return out.select(F.round(F.col("mse") / 1e6, 4).alias("mse"), F.round("intercept", 4).alias("intercept"),
                      F.round("coef_l_quantity", 4).alias("coef_l_quantity"))
