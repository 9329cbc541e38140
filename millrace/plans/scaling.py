"""Queries over scaling and normalisation."""

from pyspark.sql import functions as F

from millrace.operators import scale as Z
from millrace.plans.registry import query

LINE = ["l_quantity", "l_extendedprice"]


def _line(t):
    return t.lineitem.select("l_orderkey", *LINE)


def _scaled(t, method, **options):
    out, _ = Z.normalise(_line(t), LINE, method, **options)
    return out.withColumns({c: F.round(c, 7) for c in LINE})


def _sql(expr, table="lineitem", extra=""):
    cells = ", ".join(f"round({expr.format(c=c, t=table)}, 7) AS {c}" for c in LINE)
    return f"SELECT l_orderkey, {cells} FROM {table}{extra}"


@query("scale_standard", "Z-1", _sql("({c} - (SELECT avg({c}) FROM {t})) / (SELECT stddev_pop({c}) FROM {t})"))
def scale_standard(t):
    return _scaled(t, "standard_scaler")


@query("scale_standard_sample", "Z-1", _sql("({c} - (SELECT avg({c}) FROM {t})) / (SELECT stddev_samp({c}) FROM {t})"))
def scale_standard_sample(t):
    return _scaled(t, "standard_scaler", sample_std=True)


@query("scale_minmax", "Z-2", _sql("({c} - (SELECT min({c}) FROM {t})) / (SELECT max({c}) - min({c}) FROM {t}) * 2 - 1"))
def scale_minmax(t):
    return _scaled(t, "minmax_scaler", feature_range=(-1.0, 1.0))


@query("scale_robust", "Z-3", _sql("({c} - (SELECT median({c}) FROM {t})) / (SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM {t})"))
def scale_robust(t):
    return _scaled(t, "robust_scaler")


@query("scale_maxabs", "Z-4", _sql("{c} / (SELECT max(abs({c})) FROM {t})"))
def scale_maxabs(t):
    return _scaled(t, "maxabs_scaler")


@query("scale_log", "Z-5", "SELECT c_custkey, round(ln(c_acctbal + (SELECT abs(min(c_acctbal)) + 1 FROM customer)), 7) AS c_acctbal FROM customer")
def scale_log(t):
    out, _ = Z.normalise(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal"], "log_transform")
    return out.withColumn("c_acctbal", F.round("c_acctbal", 7))


@query("scale_box_cox", "Z-6")
def scale_box_cox(t):
    return _scaled(t, "box_cox")


@query("scale_box_cox_given_exponent", "Z-6", _sql(
    "((sqrt({c}) - 1) / 0.5 - (SELECT avg((sqrt({c}) - 1) / 0.5) FROM {t})) / (SELECT stddev_pop((sqrt({c}) - 1) / 0.5) FROM {t})"))
def scale_box_cox_given(t):
    return _scaled(t, "box_cox", lmbda=0.5)


@query("scale_box_cox_skips_negative", "Z-6", "SELECT c_custkey, c_acctbal FROM customer")
def scale_box_cox_negative(t):
    return Z.normalise(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal"], "box_cox")[0]


@query("scale_yeo_johnson", "Z-7")
def scale_yeo_johnson(t):
    return Z.normalise(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal"], "yeo_johnson")[0]


YJ = "CASE WHEN c_acctbal >= 0 THEN (sqrt(c_acctbal + 1) - 1) / 0.5 ELSE -(pow(1 - c_acctbal, 1.5) - 1) / 1.5 END"


@query("scale_yeo_johnson_given_exponent", "Z-7", f"""
SELECT c_custkey, round(({YJ} - (SELECT avg({YJ}) FROM customer)) / (SELECT stddev_pop({YJ}) FROM customer), 7) AS c_acctbal FROM customer""")
def scale_yeo_johnson_given(t):
    out, _ = Z.normalise(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal"], "yeo_johnson", lmbda=0.5)
    return out.withColumn("c_acctbal", F.round("c_acctbal", 7))


KNOTS = """
WITH v AS (SELECT quantile_cont(c_acctbal, [{probs}]) AS qs FROM customer),
r AS (SELECT c_custkey, c_acctbal, qs, len(list_filter(qs, lambda x: x <= c_acctbal)) AS le, len(list_filter(qs, lambda x: x < c_acctbal)) AS lt FROM customer, v)
SELECT c_custkey, round(CASE WHEN c_acctbal <= qs[1] THEN 0 WHEN c_acctbal >= qs[1000] THEN 1 WHEN le > lt THEN (lt + le - 1) / 2.0 / 999
  ELSE (le - 1 + (c_acctbal - qs[le]) / (qs[le + 1] - qs[le])) / 999 END, 6) AS c_acctbal FROM r"""


@query("scale_quantile_uniform", "Z-9", KNOTS.format(probs=", ".join(f"{i / 999!r}" for i in range(1000))))
def scale_quantile_uniform(t):
    out, _ = Z.normalise(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal"], "quantile_uniform")
    return out.withColumn("c_acctbal", F.round("c_acctbal", 6))


@query("scale_quantile_normal", "Z-8")
def scale_quantile_normal(t):
    return Z.normalise(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal"], "quantile_normal")[0]


@query("scale_decimal", "Z-10", _sql("{c} / pow(10, ceil(log10((SELECT max(abs({c})) FROM {t}))))").replace(", 7)", ", 9)"))
def scale_decimal(t):
    out, _ = Z.normalise(_line(t), LINE, "decimal_scaling")
    return out.withColumns({c: F.round(c, 9) for c in LINE})


@query("scale_mean", "Z-11", _sql("({c} - (SELECT avg({c}) FROM {t})) / (SELECT max({c}) - min({c}) FROM {t})"))
def scale_mean(t):
    return _scaled(t, "mean_normalisation")


@query("scale_unit_vector", "Z-12", _sql("{c} / (SELECT sqrt(sum({c} * {c})) FROM {t})"))
def scale_unit_vector(t):
    return _scaled(t, "unit_vector")


@query("pca_two_columns", "Z-13", """
WITH s AS (SELECT avg(p_size) mx, avg(p_retailprice) my, var_samp(p_size) a, var_samp(p_retailprice) c, covar_samp(p_size, p_retailprice) b FROM part),
e AS (SELECT *, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS l1 FROM s),
w AS (SELECT *, b / sqrt(b * b + (l1 - a) * (l1 - a)) AS wx, (l1 - a) / sqrt(b * b + (l1 - a) * (l1 - a)) AS wy FROM e)
SELECT p_partkey, round(((p_size - mx) * wx + (p_retailprice - my) * wy) * CASE WHEN (CASE WHEN abs(wx) > abs(wy) THEN wx ELSE wy END) < 0 THEN -1 ELSE 1 END, 4) AS pc
FROM part, w""")
def pca_two_columns(t):
    out, _ = Z.pca(t.part.select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], 2)
    return out.select("p_partkey", F.round("PCA_1", 4).alias("pc"))


@query("pca_embeddings", "Z-13")
def pca_embeddings(t):
    width = t.embeddings.select(F.size("embedding")).first()[0]
    wide = t.embeddings.select("vec_id", *[F.col("embedding")[i].alias(f"e{i}") for i in range(width)])
    return Z.pca(wide, [f"e{i}" for i in range(width)], 3)[0].select("vec_id", "PCA_1", "PCA_2", "PCA_3")


@query("batch_normalise", "Z-14", """
SELECT l_orderkey, round((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem), 7) AS l_quantity,
  round(l_extendedprice / (SELECT max(abs(l_extendedprice)) FROM lineitem), 7) AS l_extendedprice FROM lineitem""")
def batch_normalise(t):
    out, _ = Z.batch_normalise(_line(t), {"standard_scaler": ["l_quantity"], "maxabs_scaler": ["l_extendedprice"]})
    return out.withColumns({c: F.round(c, 7) for c in LINE})


def _there_and_back(t, method, **options):
    df = t.customer.select("c_custkey", "c_acctbal")
    out, params = Z.normalise(df, ["c_acctbal"], method, **options)
    return Z.inverse(out, params).withColumn("c_acctbal", F.round("c_acctbal", 2))


for _m in ("standard_scaler", "minmax_scaler", "robust_scaler", "log_transform", "yeo_johnson"):
    query(f"inverse_{_m}", "Z-15", "SELECT c_custkey, c_acctbal FROM customer")(
        lambda t, m=_m: _there_and_back(t, m))


@query("scaler_parameters", "Z-15", """
SELECT 'l_quantity' AS "column", 'standard_scaler' AS type, 'mean' AS parameter, round(avg(l_quantity), 6) AS value FROM lineitem
UNION ALL SELECT 'l_quantity', 'standard_scaler', 'scale', round(stddev_pop(l_quantity), 6) FROM lineitem""")
def scaler_parameters(t):
    params = Z.fit(t.lineitem, ["l_quantity"], "standard_scaler")
    return Z.params_table(t.lineitem, params).withColumn("value", F.round("value", 6))


@query("normalisation_summary", "Z-16", """
SELECT 'l_quantity' AS "column", round(avg(l_quantity), 6) AS mean_before, round(stddev_samp(l_quantity), 6) AS std_before,
  min(l_quantity) AS min_before, max(l_quantity) AS max_before,
  round(avg(l_quantity / 50), 6) AS mean_after, round(stddev_samp(l_quantity / 50), 6) AS std_after, min(l_quantity / 50) AS min_after, 1.0::DOUBLE AS max_after
FROM lineitem""")
def normalisation_summary(t):
    out, _ = Z.normalise(_line(t), ["l_quantity"], "maxabs_scaler")
    s = Z.normalisation_summary(t.lineitem, out, ["l_quantity"])
    return s.withColumns({c: F.round(c, 6) for c in s.columns if c.startswith(("mean", "std"))})
