"""Queries over detectors and repairs."""

from pyspark.sql import functions as F

from millrace.operators import anomaly as A
from millrace.operators import detectors as D
from millrace.operators import multivariate as MV
from millrace.operators import repair as X
from millrace.plans.registry import query

# Standardised order totals, the column every single-model query looks at.
Z = """z AS (SELECT o_orderkey AS k, (o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders) AS x FROM orders)"""


def _orders(t):
    return t.orders.selectExpr("o_orderkey AS k", "o_totalprice AS price")


def _detect(t, model):
    found = A.detect(_orders(t), ["k"], ["price"], [model])
    return found.select("k", F.round("score", 5).alias("score"), "label")


def _labelled(scores, digits=5):
    return f"WITH {Z}, {scores} SELECT k, round(score, {digits}) AS score, (score > (SELECT quantile_cont(score, 0.9) FROM s))::INTEGER AS label FROM s"


@query("standardised_values", "X-1", """
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_nationkey END AS n, CASE WHEN c_custkey % 5 = 0 THEN 'x' ELSE c_custkey::VARCHAR END AS txt FROM customer),
f AS (SELECT c_custkey, coalesce(n, (SELECT n FROM c WHERE n IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))::DOUBLE AS n,
  coalesce(try_cast(txt AS DOUBLE), (SELECT min(try_cast(txt AS DOUBLE)) FROM c)) AS txt FROM c)
SELECT c_custkey, round((n - (SELECT avg(n) FROM f)) / (SELECT stddev_pop(n) FROM f), 6) AS n, round((txt - (SELECT avg(txt) FROM f)) / (SELECT stddev_pop(txt) FROM f), 6) AS txt FROM f""")
def standardised_values(t):
    df = t.customer.selectExpr("c_custkey", "IF(c_custkey % 7 = 0, NULL, c_nationkey) AS n",
                               "IF(c_custkey % 5 = 0, 'x', string(c_custkey)) AS txt", "c_name AS empty")
    out = A.preprocess(df, ["n", "txt", "empty"], ["c_custkey"])
    return out.withColumns({c: F.round(c, 6) for c in ("n", "txt")})


@query("detect_mad", "X-MAD X-ROD", f"""
WITH {Z}, m AS (SELECT median(x) AS med FROM z), d AS (SELECT median(abs(x - med)) AS dev FROM z, m),
s AS (SELECT k, 0.6745 * abs(x - med) / dev AS score FROM z, m, d) SELECT k, round(score, 5) AS score, (score > 3.5)::INTEGER AS label FROM s""")
def detect_mad(t):
    return _detect(t, "MAD")


BINS = """e AS (SELECT min(x) lo, (max(x) - min(x)) / 10 w, count(*) n FROM z), b AS (SELECT k, x, least(floor((x - lo) / w), 9) AS b FROM z, e),
h AS (SELECT b, count(*) AS c FROM b GROUP BY b)"""


@query("detect_hbos", "X-HBOS", _labelled(f"{BINS}, s AS (SELECT k, -log2(c / (n * w) + 0.1) AS score FROM b JOIN h USING (b), e)"))
def detect_hbos(t):
    return _detect(t, "HBOS")


@query("detect_loda", "X-LODA", _labelled(f"{BINS}, s AS (SELECT k, -ln(c / n + 1e-12) AS score FROM b JOIN h USING (b), e)"))
def detect_loda(t):
    return _detect(t, "LODA")


TAILS = "u AS (SELECT k, x, -ln(cume_dist() OVER (ORDER BY x)) AS l, -ln(cume_dist() OVER (ORDER BY x DESC)) AS r FROM z), w AS (SELECT skewness(x) AS sk FROM z)"


@query("detect_ecod", "X-ECOD", _labelled(f"{TAILS}, s AS (SELECT k, greatest(l, r) AS score FROM u, w)"))
def detect_ecod(t):
    return _detect(t, "ECOD")


@query("detect_copod", "X-COPOD", _labelled(f"{TAILS}, s AS (SELECT k, greatest((l + r) / 2, CASE WHEN sk < 0 THEN l ELSE r END) AS score FROM u, w)"))
def detect_copod(t):
    return _detect(t, "COPOD")


def _near(k):
    return f"""p AS (SELECT k, x, row_number() OVER (ORDER BY x, k) AS i FROM z),
n AS (SELECT a.k, a.x, a.i, b.i AS j, b.x AS y, abs(a.x - b.x) AS d, row_number() OVER (PARTITION BY a.i ORDER BY abs(a.x - b.x), b.i) AS r
  FROM p a JOIN range(-{k}, {k} + 1) o(off) ON off <> 0 JOIN p b ON b.i = a.i + off)"""


@query("detect_knn", "X-KNN", _labelled(f"{_near(5)}, s AS (SELECT k, d AS score FROM n WHERE r = 5)", 7))
def detect_knn(t):
    found = A.detect(_orders(t), ["k"], ["price"], ["KNN"])
    return found.select("k", F.round("score", 7).alias("score"), "label")


@query("detect_lof", "X-LOF", _labelled(f"""{_near(20)}, t AS (SELECT * FROM n WHERE r <= 20), kd AS (SELECT i, max(d) AS kd FROM t GROUP BY i),
l AS (SELECT t.i, 1 / (avg(greatest(kd.kd, t.d)) + 1e-10) AS dens FROM t JOIN kd ON kd.i = t.j GROUP BY t.i),
s AS (SELECT any_value(t.k) AS k, avg(o.dens) / any_value(m.dens) AS score FROM t JOIN l o ON o.i = t.j JOIN l m ON m.i = t.i GROUP BY t.i)"""))
def detect_lof(t):
    return _detect(t, "LOF")


@query("detect_abod", "X-ABOD", _labelled(f"""{_near(5)}, t AS (SELECT i, k, j, y - x AS v, r FROM n WHERE r <= 5 AND d > 0),
q AS (SELECT a.k, 1 / (a.v * b.v) AS c FROM t a JOIN t b ON a.i = b.i AND a.r < b.r),
v AS (SELECT k, -(avg(c * c) - avg(c) * avg(c)) AS sc FROM q GROUP BY k), s AS (SELECT z.k, coalesce(sc, -1e300) AS score FROM z LEFT JOIN v USING (k))""").replace(
    "round(score, 5) AS score", "round(ln(1 - score), 5) AS score"))
def detect_abod(t):
    found = A.detect(_orders(t), ["k"], ["price"], ["ABOD"])
    return found.select("k", F.round(F.ln(1 - F.col("score")), 5).alias("score"), "label")


@query("detect_mcd", "X-MCD", _labelled("""c AS (SELECT count(*) AS n, (count(*) + 2) // 2 AS h FROM z),
p AS (SELECT k, x, row_number() OVER (ORDER BY x, k) AS i, sum(x) OVER (ORDER BY x, k) AS s1, sum(x * x) OVER (ORDER BY x, k) AS s2 FROM z),
v AS (SELECT (a.s1 - coalesce(b.s1, 0)) / h AS m, (a.s2 - coalesce(b.s2, 0)) / h - pow((a.s1 - coalesce(b.s1, 0)) / h, 2) AS v FROM p a JOIN c ON a.i >= h LEFT JOIN p b ON b.i = a.i - h),
w AS (SELECT m, v FROM v ORDER BY v LIMIT 1), s AS (SELECT k, (x - m) * (x - m) / v AS score FROM z, w)"""))
def detect_mcd(t):
    return _detect(t, "MCD")


@query("support_fractions", "X-7", """
WITH c AS (SELECT s_acctbal AS a, s_nationkey::DOUBLE AS b, 7.0::DOUBLE AS c, s_suppkey::DOUBLE AS d, -1.0::DOUBLE AS e FROM supplier),
z AS (SELECT unnest([stddev_samp(a) / stddev_pop(a), stddev_samp(b) / stddev_pop(b), stddev_samp(c), stddev_samp(d) / stddev_pop(d), stddev_samp(e)]) AS s FROM c),
f AS (SELECT round(greatest(0.5, 1 - count(*) FILTER (WHERE s < 0.01) / count(*)), 2) AS base FROM z)
SELECT i::BIGINT AS i, round(base + (least(0.99, base + 0.4) - base) * i / 4, 9) AS fraction FROM f, range(0, 5) r(i)""")
def support_fractions(t):
    df = t.supplier.selectExpr("s_suppkey AS k", "s_acctbal AS a", "double(s_nationkey) AS b", "7D AS c", "double(s_suppkey) AS d", "-1D AS e")
    fractions = D.support_fractions(A.preprocess(df, list("abcde"), ["k"]), list("abcde"))
    return t.spark.createDataFrame([(i, round(f, 9)) for i, f in enumerate(fractions)], "i bigint, fraction double")


CUBED = """WITH v AS (SELECT o_orderkey AS k, power(o_totalprice / 1000, 3) AS v FROM orders), z AS (SELECT k, (v - (SELECT avg(v) FROM v)) / (SELECT stddev_pop(v) FROM v) AS x FROM v),
m AS (SELECT median(x) AS m FROM z), d AS (SELECT median(abs(x - m)) AS d FROM z, m), s AS (SELECT k, 0.6745 * abs(x - m) / d AS score FROM z, m, d)"""


def _cubed(t, model):
    found = A.detect(t.orders.selectExpr("o_orderkey AS k", "power(o_totalprice / 1000, 3) AS v"), ["k"], ["v"], [model])
    return found.select("k", F.round("score", 5).alias("score"), "label")


@query("detect_mad_skewed", "X-MAD", CUBED + " SELECT k, round(score, 5) AS score, (score > 3.5)::INTEGER AS label FROM s")
def detect_mad_skewed(t):
    return _cubed(t, "MAD")


@query("detect_rod", "X-ROD", CUBED + " SELECT k, round(score, 5) AS score, (score > (SELECT quantile_cont(score, 0.9) FROM s))::INTEGER AS label FROM s")
def detect_rod(t):
    return _cubed(t, "ROD")


@query("detect_pca", "X-PCA", _labelled("s AS (SELECT k, x * x AS score FROM z)"))
def detect_pca(t):
    return _detect(t, "PCA")


@query("detect_gmm", "X-GMM", _labelled("s AS (SELECT k, 0.5 * ln(2 * pi()) + x * x / 2 AS score FROM z)"))
def detect_gmm(t):
    return _detect(t, "GMM")


@query("detect_kde", "X-KDE", """
WITH z AS (SELECT c_custkey AS k, (c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer) AS x FROM customer),
s AS (SELECT a.k, -ln(avg(exp(-0.5 * (a.x - b.x) * (a.x - b.x))) / sqrt(2 * pi())) AS score FROM z a, z b GROUP BY a.k)
SELECT k, round(score, 6) AS score, (score > (SELECT quantile_cont(score, 0.9) FROM s))::INTEGER AS label FROM s""")
def detect_kde(t):
    found = A.detect(t.customer.selectExpr("c_custkey AS k", "c_acctbal AS v"), ["k"], ["v"], ["KDE"])
    return found.select("k", F.round("score", 6).alias("score"), "label")


@query("detect_qmcd", "X-QMCD", _labelled("""e AS (SELECT min(x) lo, max(x) - min(x) w FROM z), u AS (SELECT k, (x - lo) / w AS u FROM z, e),
t AS (SELECT sum(u) AS s1, sum(u * u) AS s2, count(*) AS n FROM u),
c AS (SELECT k, u, sum(u) OVER (ORDER BY u) AS cs, count(*) OVER (ORDER BY u) AS cn FROM u),
r AS (SELECT k, 1.5 - ((u * cn - cs + (s1 - cs) - u * (n - cn)) - (n * u * u - 2 * u * s1 + s2)) / n AS sc FROM c, t),
y AS (SELECT min(sc) mn, max(sc) mx, skewness(sc) sk FROM r), s AS (SELECT k, CASE WHEN sk < 0 THEN mx + mn - sc ELSE sc END AS score FROM r, y)"""))
def detect_qmcd(t):
    return _detect(t, "QMCD")


def _standard(name, scores):
    return f"{name} AS (WITH {scores} SELECT k, (score - avg(score) OVER ()) / stddev_pop(score) OVER () AS v FROM s)"


@query("detect_suod", "X-SUOD", _labelled(", ".join([
    _standard("s1", f"{_near(5)}, s AS (SELECT k, d AS score FROM n WHERE r = 5)"),
    _standard("s2", f"{BINS}, s AS (SELECT k, -log2(c / (n * w) + 0.1) AS score FROM b JOIN h USING (b), e)"),
    _standard("s3", f"{TAILS}, s AS (SELECT k, greatest(l, r) AS score FROM u, w)"),
    _standard("s4", f"{TAILS}, s AS (SELECT k, greatest((l + r) / 2, CASE WHEN sk < 0 THEN l ELSE r END) AS score FROM u, w)"),
    "s AS (SELECT k, avg(v) AS score FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4) GROUP BY k)"])))
def detect_suod(t):
    return _detect(t, "SUOD")


@query("detect_sampling", "X-Sampling", _labelled(
    "p AS (SELECT x FROM z ORDER BY md5(k || '|42'), k LIMIT 20), s AS (SELECT z.k, min(abs(z.x - p.x)) AS score FROM z, p GROUP BY z.k)"))
def detect_sampling(t):
    return _detect(t, "Sampling")


for _m, _id in {
    "IForest": "X-IForest", "INNE": "X-INNE", "OCSVM": "X-OCSVM", "DIF": "X-DIF", "KPCA": "X-KPCA",
}.items():
    query(f"detect_{_m.lower()}", _id)(lambda t, m=_m: _detect(t, m))


def _sos_sql():
    step = "CASE WHEN ln(z) + e / z > {p} THEN m ELSE lo END AS lo, CASE WHEN ln(z) + e / z > {p} THEN hi ELSE m END AS hi".format(p=f"ln({MV.SOS_PERPLEXITY})")
    return f"""p AS (SELECT x, count(*) AS c FROM z GROUP BY x),
q AS (SELECT x, c, lead(x, {MV.SOS_K}, 1e9) OVER (ORDER BY x) AS up, lag(x, {MV.SOS_K}, -1e9) OVER (ORDER BY x) AS down FROM p),
n AS (SELECT a.x, a.c, b.x AS y, b.c AS w, (a.x - b.x) * (a.x - b.x) AS d FROM q a JOIN p b ON b.x BETWEEN a.down AND a.up AND a.x <> b.x),
k AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY x ORDER BY d, y) <= {MV.SOS_K}),
l AS (SELECT *, d - min(d) OVER (PARTITION BY x) AS g FROM (SELECT * FROM k UNION ALL SELECT x, c, x, c - 1, 0 FROM p WHERE c > 1)),
t AS (SELECT x, -{MV.SOS_RANGE}::DOUBLE AS lo, {MV.SOS_RANGE}::DOUBLE AS hi, 0 AS i FROM (SELECT DISTINCT x FROM l) UNION ALL
  SELECT x, {step}, i + 1 FROM (SELECT t.x, t.lo, t.hi, t.i, (t.lo + t.hi) / 2 AS m, sum(w * exp(-exp((t.lo + t.hi) / 2) * g)) AS z,
    sum(w * exp((t.lo + t.hi) / 2) * g * exp(-exp((t.lo + t.hi) / 2) * g)) AS e FROM t JOIN l USING (x) WHERE t.i < {MV.SOS_HALVINGS} GROUP BY ALL)),
b AS (SELECT x, exp((lo + hi) / 2) AS beta FROM t WHERE i = {MV.SOS_HALVINGS}),
a AS (SELECT y, CASE WHEN x = y THEN c - 1 ELSE c END AS c, least(exp(-beta * g) / sum(w * exp(-beta * g)) OVER (PARTITION BY x), 1 - 1e-12) AS s FROM l JOIN b USING (x)),
f AS (SELECT y AS x, exp(sum(c * ln(1 - s))) AS score FROM a GROUP BY y),
s AS (SELECT z.k, coalesce(f.score, 1) AS score FROM z LEFT JOIN f USING (x))"""


@query("detect_sos", "X-SOS", _labelled(_sos_sql()).replace("WITH ", "WITH RECURSIVE ", 1))
def detect_sos(t):
    return _detect(t, "SOS")


def _loci_sql():
    parts = []
    for i, r in enumerate(MV.LOCI_RADII):
        near = lambda w: f"(ORDER BY x RANGE BETWEEN {w} PRECEDING AND {w} FOLLOWING)"
        parts.append(f"""o{i} AS (SELECT k, x, w * {r!r} AS r, count(*) OVER {near(f"(w * {r!r} * {MV.LOCI_ALPHA})")} AS own FROM e),
m{i} AS (SELECT k, own, count(*) OVER {near("r")} AS n, avg(own) OVER {near("r")} AS m, avg(own::DOUBLE * own) OVER {near("r")} AS q FROM o{i})""")
    every = " UNION ALL ".join(f"SELECT k, CASE WHEN n >= {MV.LOCI_LEAST} AND q - m * m > 1e-9 * q THEN (m - own) / sqrt(q - m * m) ELSE 0 END AS g FROM m{i}" for i in range(len(parts)))
    return f"e AS (SELECT *, max(x) OVER () - min(x) OVER () AS w FROM z), {', '.join(parts)}, s AS (SELECT k, greatest(max(g), 0) AS score FROM ({every}) GROUP BY k)"


@query("detect_loci", "X-LOCI", _labelled(_loci_sql()))
def detect_loci(t):
    return _detect(t, "LOCI")


@query("detect_lmdd", "X-LMDD", _labelled(f"""r AS (SELECT k, x, r, md5(k || '|' || r) AS o FROM z, range(1, {MV.LMDD_ROUNDS + 1}) AS u(r)),
p AS (SELECT k, x, count(*) OVER w AS n, sum(x) OVER w AS s1, sum(x * x) OVER w AS s2 FROM r WINDOW w AS (PARTITION BY r ORDER BY o, k ROWS UNBOUNDED PRECEDING)),
s AS (SELECT k, max(CASE WHEN n > 1 THEN n * ((s2 / n - (s1 / n) ** 2) - ((s2 - x * x) / (n - 1) - ((s1 - x) / (n - 1)) ** 2)) ELSE 0 END) AS score FROM p GROUP BY k)"""))
def detect_lmdd(t):
    return _detect(t, "LMDD")


# Four coordinates of the embeddings, standardised.
FOUR = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in "abcd")
POINTS = f"e AS (SELECT vec_id AS k, {', '.join(f'embedding[{i + 1}]::DOUBLE AS {c}' for i, c in enumerate('abcd'))} FROM embeddings), z AS (SELECT k, {FOUR} FROM e)"


def _points(t):
    return t.embeddings.selectExpr("vec_id AS k", *[f"double(embedding[{i}]) AS {c}" for i, c in enumerate("abcd")])


def _together(t, model, columns, digits=5):
    found = A.detect(_points(t), ["k"], columns, [model])
    return found.where(F.col("column") == columns[0]).select("k", F.round("score", digits).alias("score"), "label")


def _near_sql(name, columns, k):
    gap = " + ".join(f"(x.{c} - y.{c}) * (x.{c} - y.{c})" for c in columns)
    return f"{name} AS (SELECT * FROM (SELECT x.k, y.k AS j, sqrt({gap}) AS d, row_number() OVER (PARTITION BY x.k ORDER BY {gap}, y.k) AS r FROM z x JOIN z y ON x.k <> y.k) WHERE r <= {k})"


def _scored(parts, digits=5):
    return f"WITH {POINTS}, {parts} SELECT k, round(score, {digits}) AS score, (score > (SELECT quantile_cont(score, 0.9) FROM s))::INTEGER AS label FROM s"


def _bagging_sql():
    parts, terms = [], []
    for i, (columns, n) in enumerate(MV.bags(list("abcd")).items()):
        parts += [_near_sql(f"n{i}", columns, MV.LOF_K), f"""f{i} AS (SELECT k, max(d) AS far FROM n{i} GROUP BY k),
l{i} AS (SELECT n.k, 1 / (avg(greatest(far, d)) + 1e-10) AS own FROM n{i} n JOIN f{i} f ON f.k = n.j GROUP BY n.k),
o{i} AS (SELECT n.k, {n / MV.BAGS} * avg(there.own) / any_value(here.own) AS lof FROM n{i} n JOIN l{i} there ON there.k = n.j JOIN l{i} here ON here.k = n.k GROUP BY n.k)"""]
        terms.append(f"SELECT * FROM o{i}")
    return ", ".join(parts) + f", s AS (SELECT k, sum(lof) AS score FROM ({' UNION ALL '.join(terms)}) GROUP BY k)"


@query("detect_feature_bagging", "X-FB", _scored(_bagging_sql()))
def detect_feature_bagging(t):
    return _together(t, "FB", list("abcd"))


def _sod_sql():
    use = lambda c: f"(v{c} < {MV.SOD_ALPHA} * (va + vb + vc + vd) / 4)"
    total = " + ".join(f"CASE WHEN {use(c)} THEN ({c} - m{c}) ** 2 ELSE 0 END" for c in "abcd")
    n = " + ".join(f"{use(c)}::INT" for c in "abcd")
    return f"""{_near_sql("n", "abcd", MV.SOD_K)},
h AS (SELECT a.k, a.j, count(c.j) AS h FROM n a JOIN n b ON b.k = a.k LEFT JOIN n c ON c.k = a.j AND c.j = b.j GROUP BY 1, 2),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY h DESC, j) AS r FROM h) WHERE r <= {MV.SOD_REFS}),
t AS (SELECT f.k, {', '.join(f'avg({c}) AS m{c}, var_pop({c}) AS v{c}' for c in 'abcd')} FROM f JOIN z ON z.k = f.j GROUP BY f.k),
s AS (SELECT z.k, CASE WHEN {n} > 0 THEN sqrt({total}) / ({n}) ELSE 0 END AS score FROM z JOIN t USING (k))"""


@query("detect_sod", "X-SOD", _scored(_sod_sql()))
def detect_sod(t):
    return _together(t, "SOD", list("abcd"))


ROD_SQL = f"""RECURSIVE_g(i, x, y, w) AS (
 SELECT 0, avg(a), avg(b), avg(c) FROM z
 UNION ALL SELECT i + 1, sum(a * h) / sum(h), sum(b * h) / sum(h), sum(c * h) / sum(h)
 FROM (SELECT g.i, z.*, 1 / nullif(sqrt((a - x) ** 2 + (b - y) ** 2 + (c - w) ** 2), 0) AS h FROM g, z WHERE g.i < 200) GROUP BY i),
m AS (SELECT x, y, w FROM g WHERE i = 200),
v AS (SELECT k, sqrt((a - x) ** 2 + (b - y) ** 2 + (c - w) ** 2) AS size,
 acos(greatest(-1, least(1, ((a - x) * x + (b - y) * y + (c - w) * w) / (sqrt((a - x) ** 2 + (b - y) ** 2 + (c - w) ** 2) * sqrt(x * x + y * y + w * w))))) AS angle FROM z, m),
q AS (SELECT min(angle) FILTER (WHERE angle <= pi() / 2) AS l0, max(angle) FILTER (WHERE angle <= pi() / 2) AS l1, min(angle) FILTER (WHERE angle > pi() / 2) AS h0,
 max(angle) FILTER (WHERE angle > pi() / 2) AS h1 FROM v),
a2 AS (SELECT k, size, CASE WHEN angle <= pi() / 2 THEN (angle - l0) / (l1 - l0) * (0.955 - 0.001) + 0.001 ELSE (angle - h0) / (h1 - h0) * (2.186 - pi() / 2 - 0.001) + pi() / 2 + 0.001 END AS t FROM v, q),
c AS (SELECT k, size ** 3 * cos(t) * sin(t) ** 2 AS cost FROM a2), d AS (SELECT k, abs(cost - (SELECT median(cost) FROM c)) AS away FROM c),
s AS (SELECT k, 0.6745 * away / (SELECT median(away) FROM d) AS score FROM d)"""


@query("detect_rod_triples", "X-ROD", _scored(ROD_SQL, 4).replace("WITH ", "WITH RECURSIVE ", 1).replace("RECURSIVE_g", "g"))
def detect_rod_triples(t):
    return _together(t, "ROD", list("abc"), 4)


TWO = """o AS (SELECT o_orderkey AS k, o_totalprice AS price, o_custkey AS cust FROM orders),
a AS (SELECT k, 'price' AS c, (abs(price - (SELECT avg(price) FROM o))) AS s FROM o), b AS (SELECT k, 'cust' AS c, abs(cust - (SELECT avg(cust) FROM o)) AS s FROM o),
pca AS (SELECT k, c, (s > (SELECT quantile_cont(s * s, 0.9) FROM a) ** 0.5)::INT AS l FROM a UNION ALL SELECT k, c, (s > (SELECT quantile_cont(s * s, 0.9) FROM b) ** 0.5)::INT FROM b),
m AS (SELECT (SELECT median(price) FROM o) AS mp, (SELECT median(cust) FROM o) AS mc), md AS (SELECT median(abs(price - mp)) AS dp, median(abs(cust - mc)) AS dc FROM o, m),
mad AS (SELECT k, 'price' AS c, (0.6745 * abs(price - mp) / dp > 3.5)::INT AS l FROM o, m, md UNION ALL SELECT k, 'cust', (0.6745 * abs(cust - mc) / dc > 3.5)::INT FROM o, m, md)"""


def _two(t):
    df = t.orders.selectExpr("o_orderkey AS k", "o_totalprice AS price", "o_custkey AS cust")
    return A.detect(df, ["k"], ["price", "cust"], ["PCA", "MAD"])


@query("anomaly_labels_any_model", "X-2 S-2", f"""
WITH {TWO} SELECT p.k, max(CASE WHEN p.c = 'price' THEN greatest(p.l, q.l) ELSE 0 END) AS price, max(CASE WHEN p.c = 'cust' THEN greatest(p.l, q.l) ELSE 0 END) AS cust
FROM pca p JOIN mad q USING (k, c) GROUP BY p.k""")
def anomaly_labels(t):
    return A.labels_by_column(_two(t), ["k"], ["price", "cust"])


@query("anomalies_per_model", "X-3 X-6", f"""
WITH {TWO} SELECT 'PCA' AS model, sum(l)::BIGINT AS anomalies FROM pca UNION ALL SELECT 'MAD', sum(l)::BIGINT FROM mad""")
def anomalies_per_model(t):
    return A.model_counts(_two(t))


@query("anomaly_count_matrix", "X-4", f"""
WITH {TWO} SELECT p.c AS "column", sum(p.l)::BIGINT AS "PCA", sum(q.l)::BIGINT AS "MAD" FROM pca p JOIN mad q USING (k, c) GROUP BY p.c""")
def anomaly_count_matrix(t):
    return A.count_matrix(_two(t), ["PCA", "MAD"])


@query("anomalous_rows", "X-5", f"""
WITH {TWO}, w AS (SELECT p.k, max(CASE WHEN p.c = 'price' THEN greatest(p.l, q.l) ELSE 0 END) AS price, max(CASE WHEN p.c = 'cust' THEN greatest(p.l, q.l) ELSE 0 END) AS cust
 FROM pca p JOIN mad q USING (k, c) GROUP BY p.k) SELECT * FROM w WHERE price = 1 OR cust = 1""")
def anomalous_rows(t):
    return A.anomalous_rows(_two(t), ["k"], ["price", "cust"])


# Repairs: every ninth order by key counts as anomalous.
BASE = "o AS (SELECT o_orderkey AS k, o_totalprice AS v, (o_orderkey % 9 = 4)::INT AS l FROM orders), g AS (SELECT * FROM o WHERE l = 0)"


def _fix(t, method, **options):
    df = t.orders.selectExpr("o_orderkey AS k", "o_totalprice AS v")
    labels = df.selectExpr("k", "int(k % 9 = 4) AS label")
    out = X.fix(df, "v", labels, ["k"], method, **options)
    return out.select("k", F.round("v", 4).alias("v"))


def _fixed(value, extra=""):
    return f"WITH {BASE}{extra} SELECT k, round(CASE WHEN l = 1 THEN {value} ELSE v END, 4) AS v FROM o"


@query("fix_mean", "F-1", _fixed("(SELECT round(avg(v), 3) FROM g)"))
def fix_mean(t):
    return _fix(t, "mean")


@query("fix_median", "F-2", _fixed("(SELECT median(v) FROM g)"))
def fix_median(t):
    return _fix(t, "median")


@query("fix_mode", "F-3", _fixed("(SELECT v FROM g GROUP BY v ORDER BY count(*) DESC, v LIMIT 1)"))
def fix_mode(t):
    return _fix(t, "mode")


@query("fix_interpolation", "F-4", f"""
WITH {BASE}, n AS (SELECT k, CASE WHEN l = 0 THEN v END AS v, row_number() OVER (ORDER BY k) AS i FROM o),
x AS (SELECT *, CASE WHEN v IS NOT NULL THEN i END AS q FROM n),
w AS (SELECT *, last_value(v IGNORE NULLS) OVER a AS v0, last_value(q IGNORE NULLS) OVER a AS i0, first_value(v IGNORE NULLS) OVER b AS v1, first_value(q IGNORE NULLS) OVER b AS i1
 FROM x WINDOW a AS (ORDER BY i), b AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT k, round(CASE WHEN v IS NOT NULL THEN v WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (i - i0) / (i1 - i0) END, 4) AS v FROM w""")
def fix_interpolation(t):
    return _fix(t, "interpolation")


@query("fix_nearest", "F-4", f"""
WITH {BASE}, w AS (SELECT k, l, v, lag(v) OVER (ORDER BY k) AS p FROM o) SELECT k, round(CASE WHEN l = 1 THEN p ELSE v END, 4) AS v FROM w""")
def fix_nearest(t):
    return _fix(t, "interpolation", kind="nearest")


@query("fix_knn_single_column", "F-5", _fixed("(SELECT avg(v) FROM g)"))
def fix_knn(t):
    return _fix(t, "knn")


@query("fix_knn_with_features", "F-5", """
WITH a AS (SELECT s_suppkey AS k, s_nationkey::DOUBLE AS x, s_acctbal AS v, (s_suppkey % 9 = 4) AS l FROM supplier),
d AS (SELECT g.k, n.v, row_number() OVER (PARTITION BY g.k ORDER BY (g.x - n.x) * (g.x - n.x), n.k) AS r FROM a g JOIN a n ON NOT n.l WHERE g.l)
SELECT k, round(avg(v), 4) AS v FROM d WHERE r <= 5 GROUP BY k UNION ALL SELECT k, round(v, 4) FROM a WHERE NOT l""")
def fix_knn_features(t):
    df = t.supplier.selectExpr("s_suppkey AS k", "double(s_nationkey) AS x", "s_acctbal AS v")
    out = X.fix(df, "v", df.selectExpr("k", "int(k % 9 = 4) AS label"), ["k"], "knn", features=["x"])
    return out.select("k", F.round("v", 4).alias("v"))


@query("fix_simple_mean", "F-6", _fixed("(SELECT round(avg(v), 2) FROM g)"))
def fix_simple_mean(t):
    return _fix(t, "simple", strategy="mean", decimals=2)


@query("fix_simple_most_frequent", "F-6", _fixed("(SELECT v FROM g GROUP BY v ORDER BY count(*) DESC, v LIMIT 1)"))
def fix_simple_mode(t):
    return _fix(t, "simple", strategy="most_frequent")


@query("fix_constant", "F-6", _fixed("9999"))
def fix_constant(t):
    return _fix(t, "simple", strategy="constant")


@query("fix_moving_average", "F-7", f"""
WITH {BASE}, w AS (SELECT *, avg(CASE WHEN l = 0 THEN v END) OVER (ORDER BY k ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m FROM o)
SELECT k, round(CASE WHEN l = 1 THEN m ELSE v END, 4) AS v FROM w""")
def fix_moving_average(t):
    return _fix(t, "moving_average")


@query("fix_winsorize", "F-8", f"""
WITH {BASE}, b AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM o WHERE l = 1),
e AS (SELECT max(CASE WHEN i = floor(0.05 * n) THEN v END) AS lo, max(CASE WHEN i = n - floor(0.05 * n) - 1 THEN v END) AS hi FROM b)
SELECT k, round(CASE WHEN l = 1 THEN least(greatest(v, lo), hi) ELSE v END, 4) AS v FROM o, e""")
def fix_winsorize(t):
    return _fix(t, "winsorize")


NEAR = ", q AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM g), f AS (SELECT v FROM g, q WHERE abs((v - m) / s) < 1.5), r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM f)"
_Z = {
    "mean": "(SELECT avg(v) FROM f)", "median": "(SELECT median(v) FROM f)", "mode": "(SELECT v FROM f GROUP BY v ORDER BY count(*) DESC, v LIMIT 1)",
    "trim_mean": "(SELECT avg(v) FROM r WHERE i >= floor(0.05 * n) AND i < n - floor(0.05 * n))",
    "winsorize": "(SELECT avg(least(greatest(r.v, lo), hi)) FROM r, (SELECT max(CASE WHEN i = floor(0.05 * n) THEN v END) AS lo, max(CASE WHEN i = n - floor(0.05 * n) - 1 THEN v END) AS hi FROM r))",
    "gmean": "(SELECT exp(avg(ln(v))) FROM f)", "hmean": "(SELECT 1 / avg(1 / v) FROM f)", "custom_percentile": "(SELECT quantile_cont(v, 0.9) FROM f)",
}
for _s, _q in _Z.items():
    query(f"fix_zscore_{_s}", "F-9", _fixed(_q, NEAR))(lambda t, s=_s: _fix(t, "zscore", threshold=1.5, stat=s))


@query("fix_quantile_clip", "F-10", _fixed("least(greatest(v, (SELECT quantile_cont(v, 0.05) FROM g)), (SELECT quantile_cont(v, 0.95) FROM g))"))
def fix_quantile_clip(t):
    return _fix(t, "quantile")


@query("fix_random_forest", "F-11")
def fix_random_forest(t):
    return _fix(t, "random_forest")


LOG = f"WITH {BASE}, c AS (SELECT k, 'v' AS \"column\", v AS anomaly_value, (SELECT median(v) FROM g) AS fixed_value FROM o WHERE l = 1)"


def _log(t):
    df = t.orders.selectExpr("o_orderkey AS k", "o_totalprice AS v")
    labels = df.selectExpr("k", "int(k % 9 = 4) AS label")
    return X.change_log(df, X.fix(df, "v", labels, ["k"], "median"), labels, ["k"], "v")


@query("change_log", "F-12", LOG + " SELECT * FROM c")
def change_log(t):
    return _log(t)


@query("review_table", "F-13 P-21", LOG + " SELECT *, CASE WHEN k % 2 = 0 THEN 1.5 ELSE fixed_value END AS final_value FROM c")
def review_table(t):
    edits = t.orders.where("o_orderkey % 2 = 0").selectExpr("o_orderkey AS k", "'v' AS column", "'1.5' AS value")
    return X.review_table(_log(t), edits, ["k"])
