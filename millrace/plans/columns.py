"""Queries over projections, filters, edits, joins, de-duplication and scalar functions."""

from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.functions.expressions import column_expr
from millrace.operators import columns as C
from millrace.plans.registry import query


@query("header_as_row", "P-1a S-1", """
SELECT 'r_regionkey' AS id, 'r_name' AS label, 0 AS _ord
UNION ALL SELECT CAST(r_regionkey AS VARCHAR), r_name, 1 FROM region""")
def header_as_row(t):
    return C.header_as_row(t.region, ["id", "label"])


@query("set_headers", "P-1b", "SELECT n_nationkey AS id, n_name AS label, n_regionkey AS region_id FROM nation")
def set_headers(t):
    return C.set_headers(t.nation, ["id", "label", "region_id"])


@query("rename_columns", "P-2", "SELECT r_regionkey AS region_id, r_name AS region_name FROM region")
def rename_columns(t):
    return C.rename(t.region, {"r_regionkey": "region_id", "r_name": "region_name"})


@query("assign_dtypes", "P-3", """
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, CAST(floor(o_totalprice) AS INTEGER) AS o_totalprice,
       CAST(date_trunc('month', o_orderdate) AS DATE) AS o_orderdate FROM orders""")
def assign_dtypes(t):
    df = t.orders.select("o_orderkey", "o_custkey", F.floor("o_totalprice").alias("o_totalprice"), "o_orderdate")
    return C.assign_dtypes(df, {"o_custkey": "object", "o_totalprice": "int32", "o_orderdate": "period[M]"})


@query("infer_dtypes", "P-4", """
SELECT c_custkey, c_name, CASE WHEN c_custkey % 20 = 0 THEN NULL ELSE c_acctbal END AS balance,
       TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(c_nationkey AS INTEGER)) AS since FROM customer""")
def infer_dtypes(t):
    df = t.customer.select(
        "c_custkey", "c_name",
        F.expr("CASE WHEN c_custkey % 20 = 0 THEN 'n/a' ELSE CAST(c_acctbal AS string) END AS balance"),
        F.expr("CAST(date_add(DATE'2024-01-01', c_nationkey) AS string) AS since"),
    )
    return C.infer_dtypes(df)


@query("computed_column", "P-5 U-1 U-3", """
SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net,
       pow(l_quantity, 2) AS sq,
       CASE WHEN l_tax > 0.05 AND l_quantity > 10 THEN sqrt(l_quantity) ELSE -abs(l_tax) END AS mix,
       l_quantity - (-7) * floor(l_quantity / (-7)) AS neg_mod,
       CASE WHEN l_discount = 0 THEN NULL ELSE l_tax / l_discount END AS ratio
FROM lineitem""", rounded="net sq mix neg_mod ratio", digits=8)
def computed_column(t):
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_quantity", "l_tax")
    for name, text in {
        "net": "l_extendedprice * (1 - l_discount)", "sq": "l_quantity ** 2",
        "mix": "where(l_tax > 0.05 and l_quantity > 10, sqrt(l_quantity), -abs(l_tax))",
        "neg_mod": "l_quantity % -7", "ratio": "l_tax / l_discount",
    }.items():
        li = C.add_computed(li, name, text)
    return li.select("l_orderkey", "l_linenumber", "net", "sq", "mix", "neg_mod", "ratio")


@query("computed_eval", "P-6 U-1", "SELECT p_partkey, p_retailprice / p_size + sin(pi() * p_size) AS v FROM part", rounded="v", digits=9)
def computed_eval(t):
    return t.part.select("p_partkey", column_expr("p_retailprice / p_size + sin(pi * p_size)", t.part).alias("v"))


@query("computed_placed", "P-7", "SELECT p_partkey, p_partkey * 2 AS twice, p_name, p_size + 1 AS next_size, p_size FROM part")
def computed_placed(t):
    df = t.part.select("p_partkey", "p_name", "p_size")
    df = C.add_computed(df, "twice", "p_partkey * 2", at=1)
    return C.add_computed(df, "next_size", "p_size + 1", before="p_size")


@query("row_intervals", "P-8", """
SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS p FROM orders)
WHERE p BETWEEN 10 AND 99 OR p BETWEEN 1000 AND 1200""")
def row_intervals(t):
    df = t.orders.select("o_orderkey", "o_totalprice")
    return C.row_intervals(df, [(10, 99), (1000, 1200)], ["o_totalprice", "o_orderkey"])


@query("columns_by_range", "P-9", "SELECT c_name, c_nationkey, c_acctbal FROM customer")
def columns_by_range(t):
    return C.select_columns(t.customer, index_range=(1, 3))


@query("columns_beside_reference", "P-9", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def columns_beside_reference(t):
    return C.select_columns(t.orders, reference="o_totalprice", side="left", include_reference=False)


@query("rows_by_predicate", "P-10", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000 AND o_orderstatus = 'F'""")
def rows_by_predicate(t):
    return C.keep_rows(t.orders, "o_totalprice > 250000 and o_orderstatus == 'F'").select("o_orderkey", "o_totalprice")


@query("filter_negated", "P-5 P-6 P-10 U-1 U-3", """
SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE NOT (o_orderstatus = 'F') AND NOT regexp_matches(o_orderpriority, 'URGENT|LOW')""")
def filter_negated(t):
    return C.keep_rows(t.orders, "~(o_orderstatus == 'F') & ~o_orderpriority.str.contains('URGENT|LOW')").select(
        "o_orderkey", "o_orderstatus", "o_orderpriority")


@query("delete_rows_negated", "P-11", "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IN (1, 2, 3, 5)")
def delete_rows_negated(t):
    return C.delete_rows(t.supplier, "~s_nationkey.isin([1, 2, 3, 5])").select("s_suppkey", "s_nationkey")


@query("text_split", "2.9 text/regex", """
SELECT c_custkey, string_split(c_name, '#')[2] AS second, split_part(c_mktsegment, 'I', 1) AS head FROM customer""")
def text_split(t):
    df = C.add_computed(t.customer, "second", "c_name.str.split('#').str[1]")
    return C.add_computed(df, "head", "c_mktsegment.str.split('I')[0]").select("c_custkey", "second", "head")


@query("dummy_level", "2.9 pandas", "SELECT o_orderkey, coalesce(o_orderstatus = 'O', false) AS is_open FROM orders")
def dummy_level(t):
    return C.add_computed(t.orders, "is_open", "pd.get_dummies(o_orderstatus)['O']").select("o_orderkey", "is_open")


HOLED_CUSTOMER = "(SELECT c_custkey, c_name, c_nationkey, c_mktsegment, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer)"


def holed_customer(t):
    return t.customer.withColumn("c_acctbal", F.expr("CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END"))


@query("delete_rows_by_predicate", "P-11", f"""
SELECT c_custkey, c_acctbal FROM {HOLED_CUSTOMER} WHERE c_acctbal <= 0 OR c_acctbal IS NULL""")
def delete_rows_by_predicate(t):
    return C.delete_rows(holed_customer(t), "c_acctbal > 0").select("c_custkey", "c_acctbal")


@query("delete_rows_by_key", "P-12 J-4", """
SELECT c.* FROM customer c WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""")
def delete_rows_by_key(t):
    big = t.orders.where("o_totalprice > 400000").selectExpr("o_custkey AS c_custkey")
    return C.delete_keys(t.customer, big, ["c_custkey"])


@query("delete_columns", "P-13", "SELECT s_suppkey, s_name FROM supplier")
def delete_columns(t):
    return C.delete_columns(t.supplier, ["s_acctbal", 2, "not_there"])[0]


@query("replace_contains", "P-14", "SELECT p_partkey, replace(p_name, 'ring', 'loop') AS p_name FROM part")
def replace_contains(t):
    return C.replace_pattern(t.part.select("p_partkey", "p_name"), "contains", "ring", "loop")


@query("replace_starts_ends", "P-14", """
SELECT p_partkey, CASE WHEN starts_with(p_name, 'red') THEN 'rouge' || substr(p_name, 4) ELSE p_name END AS p_name,
       CASE WHEN ends_with(p_type, 'Y') THEN substr(p_type, 1, length(p_type) - 1) || 'IE' ELSE p_type END AS p_type FROM part""")
def replace_starts_ends(t):
    df = C.replace_pattern(t.part.select("p_partkey", "p_name", "p_type"), "starts", "red", "rouge", ["p_name"])
    return C.replace_pattern(df, "ends", "Y", "IE", ["p_type"])


@query("replace_regex_null", "P-14", """
SELECT p_partkey, regexp_replace(p_name, '[aeiou]+', '_', 'g') AS p_name,
       CASE WHEN regexp_matches(p_brand, '#1') THEN NULL ELSE p_brand END AS p_brand FROM part""")
def replace_regex_null(t):
    df = C.replace_pattern(t.part.select("p_partkey", "p_name", "p_brand"), "regex", "[aeiou]+", "_", ["p_name"])
    return C.replace_pattern(df, "regex", "#1", "", ["p_brand"])


@query("replace_count", "P-14", """
SELECT CAST(sum(CASE WHEN contains(p_name, 'ring') THEN 1 ELSE 0 END) + sum(CASE WHEN contains(p_type, 'ring') THEN 1 ELSE 0 END)
 + sum(CASE WHEN contains(p_brand, 'ring') THEN 1 ELSE 0 END) AS BIGINT) AS cells_modified FROM part""")
def replace_count(t):
    return C.count_pattern(t.part, "contains", "ring")


@query("rows_with_missing", "P-15", f"SELECT c_name, c_acctbal FROM {HOLED_CUSTOMER} WHERE c_name IS NULL OR c_acctbal IS NULL")
def rows_with_missing(t):
    return C.rows_with_missing(holed_customer(t), ["c_name", "c_acctbal"])


@query("rows_by_key", "P-16 J-4", """
SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""")
def rows_by_key(t):
    big = t.orders.where("o_totalprice > 400000").selectExpr("o_custkey AS c_custkey")
    return C.fetch_keys(t.customer, big, ["c_custkey"], ["c_acctbal"])


@query("head_rows", "P-17", "SELECT * FROM customer ORDER BY c_custkey LIMIT 5")
def head_rows(t):
    return C.head(t.customer, ["c_custkey"])


@query("tail_rows", "P-17", "SELECT * FROM customer ORDER BY c_custkey DESC LIMIT 5")
def tail_rows(t):
    return C.tail(t.customer, ["c_custkey"])


@query("square_columns", "P-18", "SELECT p_partkey, p_size, p_retailprice, p_size * p_size AS \"p_size_Squared\", p_retailprice * p_retailprice AS \"p_retailprice_Squared\" FROM part")
def square_columns(t):
    return C.square_columns(t.part.select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])


@query("currency_cleaning", "P-19", """
SELECT p_partkey, p_retailprice AS "price ($)", CAST(p_size AS BIGINT) * 1000 AS "units ($)",
       CAST(DATE '2024-01-01' + p_size AS DATE) AS invoiced FROM part""")
def currency_cleaning(t):
    sheet = t.part.select(
        "p_partkey", F.expr("concat('$', format_number(p_retailprice, 2)) AS price"),
        F.expr("format_number(p_size * 1000, 0) AS units"),
        F.expr("date_format(date_add(DATE'2024-01-01', p_size), 'M/d/yyyy') AS invoiced"),
    )
    return C.clean_sales_sheet(sheet, {"price": "double", "units": "bigint"}, "invoiced")


@query("year_filter", "P-20", "SELECT o_orderkey, o_orderdate FROM orders WHERE year(o_orderdate) = 1997")
def year_filter(t):
    return C.in_year(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", 1997)


@query("human_edits", "P-21", """
SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN 'checked' ELSE c_mktsegment END AS c_mktsegment,
       CASE WHEN c_custkey % 75 = 0 THEN 1.5 ELSE c_acctbal END AS c_acctbal FROM customer""")
def human_edits(t):
    df = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    edits = df.selectExpr("c_custkey", "explode(filter(array("
                          "IF(c_custkey % 50 = 0, struct('c_mktsegment' AS column, 'checked' AS value), NULL),"
                          "IF(c_custkey % 75 = 0, struct('c_acctbal' AS column, '1.5' AS value), NULL)), x -> x IS NOT NULL)) AS e"
                          ).select("c_custkey", "e.column", "e.value")
    return C.apply_edits(df, edits, ["c_custkey"])


@query("value_lookup", "J-1 V-15", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def value_lookup(t):
    mapping = t.orders.select("o_orderstatus").distinct().selectExpr(
        "o_orderstatus AS term", "CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' END AS fixed")
    return C.lookup(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", mapping, "term", "fixed")


@query("side_by_side", "J-2", """
SELECT c_custkey AS k, c_acctbal, s_acctbal FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey""")
def side_by_side(t):
    left = t.customer.selectExpr("c_custkey AS k", "c_acctbal")
    return C.attach(left, t.supplier.selectExpr("s_suppkey AS k", "s_acctbal"), ["k"])


@query("union_tables", "S-2", """
SELECT c_custkey AS k, c_acctbal AS bal, 'customer' AS kind FROM customer
UNION ALL SELECT s_suppkey, s_acctbal, 'supplier' FROM supplier""")
def union_tables(t):
    return t.customer.selectExpr("c_custkey AS k", "c_acctbal AS bal", "'customer' AS kind").unionByName(
        t.supplier.selectExpr("'supplier' AS kind", "s_suppkey AS k", "s_acctbal AS bal"))


@query("drop_duplicate_rows", "D-1", "SELECT min(doc_id) AS doc_id, text, lang FROM documents GROUP BY text, lang")
def drop_duplicate_rows(t):
    return C.distinct_rows(t.documents.select("doc_id", "text", "lang"), ["doc_id"])


@query("drop_duplicates_all_columns", "D-1", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def drop_duplicates_all(t):
    return C.distinct_rows(t.lineitem.select("l_orderkey", "l_linenumber"))


@query("count_duplicates", "D-2 D-3", """
SELECT CAST(sum(n) AS BIGINT) AS "rows", CAST(sum(n - 1) AS BIGINT) AS duplicates, sum(n - 1) / sum(n) AS dedup_ratio
FROM (SELECT count(*) AS n FROM documents GROUP BY text)""")
def count_duplicates(t):
    return C.duplicate_counts(t.documents, ["text"])


@query("scalar_math", "2.9 math", """
SELECT p_partkey, log10(p_retailprice) AS lg, exp(p_size / 10.0) AS ex, atan(p_size) AS at, degrees(p_size) AS dg,
       sinh(p_size / 10.0) AS sh, gcd(CAST(p_partkey AS BIGINT), CAST(p_size AS BIGINT)) AS g,
       trunc(-p_retailprice / 7) AS tr, abs(p_size - 25) <= 0.1 * greatest(p_size, 25) AS cl, factorial(p_size % 10)::BIGINT AS fc
FROM part""", rounded="lg ex at dg sh", digits=9)
def scalar_math(t):
    p, texts = t.part, {
        "lg": "log10(p_retailprice)", "ex": "exp(p_size / 10.0)", "at": "atan(p_size)", "dg": "degrees(p_size)",
        "sh": "sinh(p_size / 10.0)", "g": "gcd(p_partkey, p_size)", "tr": "trunc(-p_retailprice / 7)",
        "cl": "isclose(p_size, 25, 0.1)", "fc": "factorial(int(p_size % 10))",
    }
    out = p.select("p_partkey", *[column_expr(x, p).alias(n) for n, x in texts.items()])
    return out.withColumn("tr", F.col("tr").cast("double"))


@query("scalar_numeric", "2.9 numpy scalar", """
SELECT p_partkey, least(greatest(p_size, 10), 40) AS clipped,
       CASE WHEN p_size >= 30 THEN 3 WHEN p_size >= 20 THEN 2 WHEN p_size >= 10 THEN 1 ELSE 0 END AS bin,
       CASE WHEN p_size <= 10 THEN p_size / 10.0 WHEN p_size <= 30 THEN 1 + (p_size - 10) * 0.2 ELSE 5 END AS curve,
       ln(1 + p_size) AS l1, exp(p_size / 50.0) - 1 AS e1, log2(p_size) AS l2, sign(p_size - 25)::INTEGER AS sg, p_size = -1 AS inf
FROM part""", rounded="curve l1 e1 l2", digits=9)
def scalar_numeric(t):
    size = F.col("p_size")
    return t.part.select(
        "p_partkey", S.clip(size, F.lit(10), F.lit(40)).alias("clipped"), S.digitize(size, [10, 20, 30]).alias("bin"),
        S.interp(size, [0, 10, 30], [0, 1, 5]).alias("curve"), F.log1p(size).alias("l1"),
        F.expm1(size / 50).alias("e1"), F.log2(size).alias("l2"), F.signum(size - 25).cast("int").alias("sg"),
        S.is_inf(size).alias("inf"),
    )


@query("scalar_aggregates", "2.9 numpy aggregate", """
SELECT o_orderkey, round(o_totalprice - avg(o_totalprice) OVER (), 6) AS centred, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER (), 6) AS z,
       round(stddev_samp(o_totalprice) OVER () / sqrt(var_pop(o_totalprice) OVER ()), 9) AS ratio, round(corr(o_totalprice, o_custkey) OVER (), 9) AS r,
       round(covar_samp(o_totalprice, o_custkey) OVER (), 3) AS cov, (SELECT count(DISTINCT o_custkey) FROM orders) AS n_unique,
       o_totalprice > (SELECT quantile_cont(o_totalprice, 0.75) FROM orders) AS high, o_totalprice = max(o_totalprice) OVER () AS top FROM orders""")
def scalar_aggregates(t):
    df = t.orders
    texts = {
        "centred": "o_totalprice - mean(o_totalprice)", "z": "(o_totalprice - np.mean(o_totalprice)) / std(o_totalprice)",
        "ratio": "o_totalprice.std() / sqrt(var(o_totalprice))", "r": "corrcoef(o_totalprice, o_custkey)", "cov": "cov(o_totalprice, o_custkey)",
        "n_unique": "nunique(o_custkey)", "high": "o_totalprice > percentile(o_totalprice, 75)", "top": "o_totalprice == max(o_totalprice)"}
    out = df.select("o_orderkey", *[column_expr(x, df).alias(n) for n, x in texts.items()])
    return out.withColumns({c: F.round(c, d) for c, d in {"centred": 6, "z": 6, "ratio": 9, "r": 9, "cov": 3}.items()})


@query("filter_query_syntax", "P-10 P-11 U-1", """
SELECT c_custkey FROM customer WHERE (c_acctbal > 1000 AND c_nationkey IN (1, 2, 3, 20)) OR NOT (c_mktsegment <> 'BUILDING')
  AND contains(c_name, '7') AND c_nationkey NOT IN (5, 6) AND CASE WHEN c_acctbal > 0 THEN c_nationkey > 3 ELSE c_custkey % 2 = 0 END""")
def filter_query_syntax(t):
    df = t.customer.withColumnRenamed("c_acctbal", "account balance")
    return C.keep_rows(df, """(`account balance` > 1000) & (c_nationkey in [1, 2, 3, 20]) | ~(c_mktsegment != "BUILDING")
        & c_name.str.contains('7') & c_nationkey not in (5, 6) & (c_nationkey > 3 if `account balance` > 0 else c_custkey % 2 == 0)""".replace("\n", " ")).select("c_custkey")


@query("delete_query_syntax", "P-11", """
SELECT p_partkey FROM part WHERE NOT ((p_size BETWEEN 10 AND 20 AND p_retailprice > 1000) OR starts_with(lower(p_name), 'a') OR p_size = 7)""")
def delete_query_syntax(t):
    return C.delete_rows(t.part, "p_size.between(10, 20) & (df['p_retailprice'] > 1e3) | p_name.str.lower().str.startswith('a') | df.p_size.isin([7])").select("p_partkey")


@query("computed_binned", "P-5 P-6 2.9 pandas numpy scalar", """
WITH q AS (SELECT quantile_cont(p_retailprice, 0.25) AS a, quantile_cont(p_retailprice, 0.5) AS b, quantile_cont(p_retailprice, 0.75) AS c FROM part)
SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'small' WHEN p_size <= 30 THEN 'middle' ELSE 'large' END AS band,
       CASE WHEN p_retailprice <= a THEN 0 WHEN p_retailprice <= b THEN 1 WHEN p_retailprice <= c THEN 2 ELSE 3 END AS quarter,
       (p_size >= 10)::INT + (p_size >= 20)::INT AS step, CASE WHEN p_size > 40 THEN 1 WHEN p_size > 20 THEN 2 ELSE 0 END AS pick,
       round(CASE WHEN p_size <= 10 THEN p_size / 10.0 WHEN p_size <= 50 THEN 1 + (p_size - 10) / 10.0 ELSE 5 END, 9) AS curve,
       (p_size // 7)::DOUBLE AS whole, (p_size % 7)::DOUBLE AS rest, p_size + p_partkey AS total, 3.5::DOUBLE AS lin FROM part, q""")
def computed_binned(t):
    df, out = t.part, t.part.select("p_partkey", "p_size", "p_retailprice")
    texts = {
        "band": "pd.cut(p_size, bins=[0, 10, 30, 1000], labels=['small', 'middle', 'large'])", "quarter": "qcut(p_retailprice, 4)", "step": "np.digitize(p_size, [10, 20])",
        "pick": "select([p_size > 40, p_size > 20], [1, 2], 0)", "curve": "interp(p_size, [0, 10, 50], [0, 1, 5])", "whole": "divmod(p_size, 7)[0]",
        "rest": "divmod(p_size, 7)[1]", "total": "sum([p_size, p_partkey])", "lin": "linspace(2, 4, 5)[3]"}
    out = df.select("p_partkey", *[column_expr(x, df).alias(n) for n, x in texts.items()])
    return out.withColumns({"curve": F.round("curve", 9), "total": F.col("total").cast("bigint")})


@query("computed_dates", "P-5 P-6 2.9 date parts text regex timedelta", """
SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, monthname(o_orderdate) AS mn, (o_orderdate + INTERVAL 3 DAY + INTERVAL 2 HOUR)::TIMESTAMP AS later,
       date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS days, regexp_replace(o_orderpriority, '[0-9]-', '', 'g') AS word, regexp_matches(o_orderpriority, '^[12]') AS urgent,
       nullif(regexp_extract(o_orderpriority, '([A-Z]+)$', 1), '') AS tail, substr(o_orderpriority, 1, 1)::DOUBLE AS level FROM orders""")
def computed_dates(t):
    df = t.orders.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))
    texts = {
        "y": "o_orderdate.dt.year", "q": "o_orderdate.dt.quarter", "mn": "o_orderdate.dt.month_name()", "later": "o_orderdate + timedelta(days=3, hours=2)",
        "word": "re.sub('[0-9]-', '', o_orderpriority)", "urgent": "re.search('^[12]', o_orderpriority)", "tail": "o_orderpriority.str.extract('([A-Z]+)$')",
        "level": "to_numeric(o_orderpriority.str.slice(0, 1))"}
    out = df.select("o_orderkey", *[column_expr(x, df).alias(n) for n, x in texts.items()], F.datediff("o_orderdate", F.lit("1992-01-01")).cast("bigint").alias("days"))
    return out.withColumns({"y": F.col("y").cast("bigint"), "q": F.col("q").cast("bigint")})


@query("computed_along_order", "P-5 P-6 U-1 2.9 pandas", """
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS d, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END::DOUBLE AS v FROM orders)
SELECT k, coalesce(lag(v) OVER s, CASE WHEN row_number() OVER s = 1 THEN 0 END) AS prev, v - lead(v) OVER s AS step, v / nullif(lag(v, 2) OVER s, 0) - 1 AS change,
  CASE WHEN v IS NOT NULL THEN sum(v) OVER s END AS total, CASE WHEN v IS NOT NULL THEN max(v) OVER s END AS top,
  CASE WHEN v IS NOT NULL THEN min(v) OVER s END AS low, last_value(v IGNORE NULLS) OVER s AS known,
  CASE WHEN count(v) OVER t = 3 THEN avg(v) OVER t END AS mean3, CASE WHEN count(*) OVER t = 3 THEN count(v) OVER t END AS n3, avg(v) OVER s AS so_far,
  CASE WHEN v IS NOT NULL THEN v - (SELECT avg(v) FROM o) - lag(v) OVER s + (SELECT avg(v) FROM o) END AS centred
FROM o WINDOW s AS (PARTITION BY c ORDER BY d, k ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY c ORDER BY d, k ROWS 2 PRECEDING)""",
       rounded="prev step change total top low known mean3 so_far centred", digits=4)
def computed_along_order(t):
    df = t.orders.selectExpr("o_orderkey AS k", "o_custkey AS c", "o_orderdate AS d", "double(IF(o_orderkey % 9 = 0, NULL, o_totalprice)) AS v")
    texts = {
        "prev": "v.shift(1, fill_value=0)", "step": "v.diff(-1)", "change": "v.pct_change(periods=2)", "total": "v.cumsum()", "top": "v.cummax()",
        "low": "v.cummin()", "known": "v.ffill()", "mean3": "v.rolling(3).mean()", "n3": "v.rolling(3).count()", "so_far": "v.expanding().mean()",
        "centred": "(v - v.mean()).diff()"}
    return C.add_many_computed(df, texts, order_by=["d", "k"], series=["c"]).select("k", *texts)


@query("computed_ranks", "P-5 P-6 U-1 2.9 pandas", """
SELECT p_partkey, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS middle,
  rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC)::DOUBLE AS low, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size)::DOUBLE AS dense,
  cume_dist() OVER (ORDER BY p_size) AS share FROM part""", rounded="middle share", digits=9)
def computed_ranks(t):
    df = t.part
    for name, text, series in (
            ("middle", "p_size.rank()", []), ("low", "p_retailprice.rank(method='min', ascending=False)", ["p_brand"]),
            ("dense", "p_size.rank(method='dense')", ["p_brand"]), ("share", "p_size.rank(method='max', pct=True)", [])):
        df = C.add_computed(df, name, text, order_by=["p_partkey"], series=series)
    return df.select("p_partkey", "middle", "low", "dense", "share")


@query("filter_along_order", "P-10 P-11 U-3", """
SELECT o_orderkey, o_totalprice FROM (SELECT o_orderkey, o_totalprice, lag(o_totalprice) OVER w AS a, lead(o_custkey) OVER w AS b, o_custkey, max(o_totalprice) OVER w AS m
  FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING))
WHERE o_totalprice - a > 1000 AND NOT b > o_custkey AND NOT (m = o_totalprice)""")
def filter_along_order(t):
    order = ["o_orderdate", "o_orderkey"]
    kept = C.delete_rows(t.orders, "~(o_totalprice.diff() > 1000) or o_totalprice.shift(1).isnull() or ~~(o_custkey.shift(-1) > o_custkey) or "
                         "o_custkey.shift(-1).isnull() or o_totalprice == o_totalprice.cummax()", order_by=order)
    return kept.select("o_orderkey", "o_totalprice")


@query("scalar_generators", "2.9 numpy generators", """
SELECT s_suppkey, (list_sum([2.0 + i * 0.5 FOR i IN range(0, 5)]) + s_suppkey)::DOUBLE AS lin, len(range(0, s_suppkey + 1)) AS seq,
       CAST(0 AS DOUBLE) AS zeros FROM supplier""")
def scalar_generators(t):
    total = F.aggregate(S.linspace(2.0, 4.0, 5), F.lit(0.0), lambda a, x: a + x)
    return t.supplier.select(
        "s_suppkey", (total + F.col("s_suppkey")).alias("lin"),
        F.size(F.sequence(F.lit(0).cast("bigint"), F.col("s_suppkey"))).cast("bigint").alias("seq"),
        F.aggregate(F.array_repeat(F.lit(0.0), 4), F.lit(0.0), lambda a, x: a + x).alias("zeros"),
    )


@query("scalar_cut", "2.9 pandas", """
SELECT c_custkey, CASE WHEN c_acctbal > -1000 AND c_acctbal <= 0 THEN 'debt' WHEN c_acctbal > 0 AND c_acctbal <= 5000 THEN 'low'
       WHEN c_acctbal > 5000 AND c_acctbal <= 10000 THEN 'high' END AS band FROM customer""")
def scalar_cut(t):
    return t.customer.select("c_custkey", S.cut(F.col("c_acctbal"), [-1000, 0, 5000, 10000], ["debt", "low", "high"]).alias("band"))


@query("scalar_builtins", "2.9 built-ins constants names text", """
SELECT c_custkey, round_even(c_acctbal, 0) AS r, least(c_acctbal, 100) AS lo, length(c_name) AS n, c_nationkey // 3 AS q,
       c_nationkey * 2 * pi() AS tau_k, upper(c_name) AS up FROM customer""")
def scalar_builtins(t):
    df = t.customer.withColumnRenamed("c_acctbal", "account balance (usd)")
    return df.select("c_custkey", *[column_expr(x, df).alias(n) for n, x in {
        "r": "round(account_balance_usd)", "lo": "min(account_balance_usd, 100)", "n": "len(c_name)",
        "q": "int(c_nationkey // 3)", "tau_k": "c_nationkey * tau", "up": "upper(c_name)"}.items()]
    ).withColumns({"n": F.col("n").cast("bigint"), "q": F.col("q").cast("int")})


@query("date_parts", "2.9 date parts", """
SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m, weekofyear(o_orderdate) AS w,
       day(o_orderdate) AS d, hour(o_orderdate) AS h, monthname(o_orderdate) AS mn, dayname(o_orderdate) AS dn FROM orders""")
def date_parts(t):
    d = F.col("o_orderdate")
    return t.orders.select(
        "o_orderkey", *[f(d).cast("bigint").alias(n) for n, f in {
            "y": F.year, "q": F.quarter, "m": F.month, "w": F.weekofyear, "d": F.day, "h": F.hour}.items()],
        S.month_name(d).alias("mn"), S.day_name(d).alias("dn"),
    )


@query("free_function_step", "U-2 U-4", "SELECT r_regionkey, lower(trim(r_name)) AS r_name FROM region")
def free_function_step(t):
    return t.region.transform(lambda df: df.withColumn("r_name", F.lower(F.trim("r_name"))))
