"""Queries over table comparison and quality scores."""

from pyspark.sql import functions as F

from millrace.operators import compare as K
from millrace.operators import missing as M
from millrace.operators import quality as Q
from millrace.operators import values as V
from millrace.plans.columns import HOLED_CUSTOMER, holed_customer
from millrace.plans.registry import query

CHANGED = "(SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'X' ELSE c_mktsegment END AS seg, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS bal FROM customer)"


def changed(t):
    return t.customer.selectExpr("c_custkey", "IF(c_custkey % 10 = 0, 'X', c_mktsegment) AS seg", "IF(c_custkey % 4 = 0, NULL, c_acctbal) AS bal")


def base(t):
    return t.customer.selectExpr("c_custkey", "c_mktsegment AS seg", "IF(c_custkey % 8 = 0, NULL, c_acctbal) AS bal")


BASE = "(SELECT c_custkey, c_mktsegment AS seg, CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE c_acctbal END AS bal FROM customer)"
PAIR = f"(SELECT a.c_custkey, a.seg AS sa, b.seg AS sb, a.bal AS ba, b.bal AS bb FROM {BASE} a JOIN {CHANGED} b USING (c_custkey))"


@query("compare_columns_null_safe", "Q-1 J-3", f"""
SELECT count(*) AS total, count_if(ba IS NOT DISTINCT FROM bb)::BIGINT AS matches, round(count_if(ba IS NOT DISTINCT FROM bb) * 100.0::DOUBLE / count(*), 2) AS accuracy FROM {PAIR}""")
def compare_null_safe(t):
    return K.compare_columns(base(t), changed(t), "bal", "bal", ["c_custkey"])


@query("compare_mismatches", "Q-1 J-3", f"SELECT c_custkey, ba AS value_a, bb AS value_b FROM {PAIR} WHERE ba IS DISTINCT FROM bb")
def compare_mismatches(t):
    return K.mismatches(base(t), changed(t), "bal", "bal", ["c_custkey"])


@query("compare_rows", "Q-2", f"""
SELECT count(*) AS total, count_if(ba = bb)::BIGINT AS matches, round(count_if(ba = bb) * 100.0::DOUBLE / count(*), 2) AS accuracy FROM {PAIR}""")
def compare_rows(t):
    return K.compare_columns(base(t), changed(t), "bal", "bal", ["c_custkey"], null_safe=False)


@query("cell_accuracy", "Q-3", f"""
SELECT round((count_if(ba IS NOT DISTINCT FROM bb) + count_if(sa IS NOT DISTINCT FROM sb)) * 100.0::DOUBLE / (2 * count(*)), 2) AS accuracy FROM {PAIR}""")
def cell_accuracy(t):
    return K.cell_accuracy(base(t), changed(t), ["c_custkey"])


@query("review_accuracy", "Q-4", f"""
WITH r AS (SELECT 'seg' AS "column", avg((sb IS NOT DISTINCT FROM sa)::INT) * 100 AS original, avg((lower(sa) IS NOT DISTINCT FROM sa)::INT) * 100 AS machine, 100.0::DOUBLE AS human FROM {PAIR}
UNION ALL SELECT 'bal', avg((bb IS NOT DISTINCT FROM ba)::INT) * 100, 100.0, 100.0 FROM {PAIR})
SELECT "column", round(original, 6) AS original, round(machine, 6) AS machine, human FROM r
UNION ALL SELECT 'overall', round(avg(original), 6), round(avg(machine), 6), avg(human) FROM r""")
def review_accuracy(t):
    human = base(t)
    out = K.review_accuracy(changed(t), human.withColumn("seg", F.lower("seg")), human, ["c_custkey"], ["seg", "bal"])
    return out.withColumns({"original": F.round("original", 6), "machine": F.round("machine", 6)})


@query("standardisation_accuracy", "Q-5", """
SELECT 1 - count_if(p_name <> replace(lower(trim(p_name)), ' ', '_'))::DOUBLE / (2 * count(*)) - count_if(p_brand <> lower(p_brand))::DOUBLE / (2 * count(*)) AS accuracy FROM part""")
def standardisation_accuracy(t):
    df = t.part.select("p_partkey", "p_name", "p_brand")
    return K.standardisation_accuracy(df, V.standard_strings(df), ["p_partkey"])


@query("total_accuracy", "Q-5 D-3 M-16", f"""
WITH a AS (SELECT 1 - count_if(c_mktsegment <> lower(c_mktsegment) OR contains(c_mktsegment, ' '))::DOUBLE / (4 * count(*))
   - count_if(c_name <> lower(c_name))::DOUBLE / (4 * count(*)) AS x FROM customer),
 c AS (SELECT (4 * count(*) + count(c_acctbal))::DOUBLE / (5 * count(*)) AS y FROM {HOLED_CUSTOMER})
SELECT round((x + y + 1.0) / 3, 9) AS total FROM a, c""")
def total_accuracy(t):
    from millrace.operators import columns as C
    df = holed_customer(t)
    one = K.standardisation_accuracy(df, V.standard_strings(df), ["c_custkey"])
    parts = one.join(M.completeness(df)).join(C.duplicate_counts(df).select("dedup_ratio"))
    return parts.select(F.round((F.col("accuracy") + F.col("completeness") + F.col("dedup_ratio")) / 3, 9).alias("total"))


@query("tables_match", "Q-6", """
SELECT unnest(['names', 'rows', 'seg', 'bal']) AS "check", unnest([true, true, false, false]) AS ok FROM customer WHERE c_custkey = 0""")
def tables_match(t):
    return K.tables_match(base(t), changed(t), ["c_custkey"])


@query("completeness_score", "Q-8", f"""
SELECT (a - b)::DOUBLE / a AS completeness FROM (SELECT count(*) - count(bal) AS a FROM {CHANGED}), (SELECT count(*) - count(bal) AS b FROM {BASE})""")
def completeness_score(t):
    return Q.completeness_score(changed(t), base(t))


@query("consistency_score", "Q-9", "SELECT (0.6 * 0.4 + 0.4 * 0.9)::DOUBLE AS consistency FROM region WHERE r_regionkey = 0")
def consistency_score(t):
    df = t.customer.selectExpr("c_custkey AS `Customer Key`", "IF(c_custkey % 2 = 0, 'text', string(c_custkey)) AS mixed", "c_name AS name")
    return Q.consistency_score(df)


@query("validity_score", "Q-10", """
SELECT ((min(p) >= 0)::INT + (min(y) >= 2014 AND max(y) <= 2024)::INT + (max(length(s)) <= 255)::INT)::DOUBLE / 3 AS validity
FROM (SELECT o_totalprice AS p, year(o_orderdate) AS y, o_orderstatus AS s FROM orders)""")
def validity_score(t):
    return Q.validity_score(t.orders.select("o_totalprice", "o_orderdate", "o_orderstatus"))


@query("quality_score", "Q-7", """
SELECT 1.0::DOUBLE AS completeness, 1.0::DOUBLE AS consistency, 2.0::DOUBLE / 3 AS validity, (0.8 + 0.4 / 3)::DOUBLE AS score FROM region WHERE r_regionkey = 0""")
def quality_score(t):
    before = t.orders.selectExpr("o_orderkey", "IF(o_orderkey % 5 = 0, NULL, o_totalprice) AS price", "o_orderdate", "o_orderstatus")
    after, _ = M.fix_missing(before, "price", "mean")
    return Q.quality_score(before, after)
