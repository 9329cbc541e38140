"""Queries over value and name standardisation, fuzzy groups, reshaping."""

from pyspark.sql import functions as F

from millrace.operators import fuzzy, names as N, reshape as R, values as V
from millrace.plans.registry import query

MESSY = """(SELECT c_custkey, '  ' || upper(c_name) || '@Example.COM ' AS email, '+44 (0)20 ' || lpad(c_custkey::VARCHAR, 8, '0') AS phone,
  '$' || c_nationkey + 1 || ',000' AS amount, strftime(DATE '2024-01-01' + c_nationkey, '%Y-%m-%d') AS day,
  strftime(TIMESTAMP '2024-01-01 10:20:30' + to_days(c_nationkey), '%Y-%m-%d %H:%M:%S') AS moment, 'marketSegment_' || lower(c_mktsegment) AS label FROM customer)"""


def messy(t):
    return t.customer.selectExpr(
        "c_custkey", "'  ' || upper(c_name) || '@Example.COM ' AS email", "'+44 (0)20 ' || lpad(string(c_custkey), 8, '0') AS phone",
        "'$' || (c_nationkey + 1) || ',000' AS amount", "string(date_add(DATE'2024-01-01', c_nationkey)) AS day",
        "date_format(timestampadd(DAY, c_nationkey, TIMESTAMP_NTZ'2024-01-01 10:20:30'), 'yyyy-MM-dd HH:mm:ss') AS moment",
        "'marketSegment_' || lower(c_mktsegment) AS label")


def _kinds_sql(columns, compat=False):
    """The kind of each column from the shares of its values that look like one."""
    shapes = [r"\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}", r"\d{2}/\d{2}/\d{4}\s+\d{2}:\d{2}", r"\d{2}-\d{2}-\d{4}\s+\d{2}:\d{2}", r"\d{8}_\d{4}"]
    rank = "WHEN phone > 0.7 THEN 'phone' WHEN numeric > 0.8 THEN 'numeric' WHEN date > 0.5 THEN 'date' WHEN datetime > 0.5 THEN 'datetime'" if compat else (
        "WHEN datetime > 0.5 THEN 'datetime' WHEN date > 0.5 THEN 'date' WHEN phone > 0.7 THEN 'phone' WHEN numeric > 0.8 THEN 'numeric'")
    number = "try_cast(replace(replace(v, ',', ''), '$', '') AS DOUBLE)"
    return " UNION ALL ".join(rf"""
SELECT '{c}' AS "column", CASE WHEN email > 0.7 THEN 'email' {rank} ELSE 'text' END AS kind FROM (
SELECT avg(contains(v, '@')::INT) AS email, avg((length(regexp_replace(v, '[^0-9]', '', 'g')) BETWEEN 7 AND 15)::INT) AS phone,
  CASE WHEN count(*) = count({number}) THEN avg(({number} <> 0)::INT) END AS numeric, avg(regexp_matches(v, '\d{{4}}-\d{{2}}-\d{{2}}')::INT) AS date,
  greatest({", ".join(f"avg(regexp_matches(v, '{p}')::INT)" for p in shapes)}) AS datetime FROM (SELECT trim({c}::VARCHAR) AS v FROM {MESSY} WHERE {c} IS NOT NULL))""" for c in columns)


@query("detect_column_types", "V-1", _kinds_sql(["email", "phone", "amount", "day", "moment", "label"]))
def detect_column_types(t):
    return V.detect_types(messy(t), ["email", "phone", "amount", "day", "moment", "label"], ["c_custkey"])


@query("detect_column_types_compat", "V-1", _kinds_sql(["phone", "day", "moment"], compat=True))
def detect_column_types_compat(t):
    return V.detect_types(messy(t), ["phone", "day", "moment"], ["c_custkey"], compat=True)


@query("auto_standardize", "V-2 V-3 V-4 V-5 V-6", f"""
SELECT c_custkey, lower(trim(email)) AS email, regexp_replace(phone, '[^0-9]', '', 'g') AS phone, replace(replace(amount, '$', ''), ',', '') || '.0' AS amount,
  strftime(day::DATE, '%d-%m-%Y') AS day, strftime(moment::TIMESTAMP, '%d-%m-%Y %H-%M-%S') AS moment,
  'market segment ' || substr(label, 15) AS label FROM {MESSY}""")
def auto_standardize(t):
    return V.auto_standardize(messy(t), ["c_custkey"])[0]


@query("standard_number_keeps_text", "V-2", """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'n/a' ELSE (p_size * 1000)::DOUBLE::VARCHAR END AS v FROM part""")
def standard_number(t):
    text = F.expr("IF(p_partkey % 3 = 0, 'n/a', '$' || format_number(p_size * 1000, 0))")
    return t.part.select("p_partkey", V.standard_number(text).alias("v"))


@query("clean_text", "V-7", r"""
SELECT doc_id, regexp_replace(regexp_replace(trim(lower(regexp_replace(regexp_replace(text, '([a-z])([A-Z])', '\1 \2', 'g'), '[_\-]+', ' ', 'g'))),
  '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g') AS clean FROM documents""")
def clean_text(t):
    return t.documents.select("doc_id", V.clean_text(F.col("text")).alias("clean"))


TYPO = "CASE WHEN p_partkey % 4 = 0 THEN substr(p_name, 1, 1) || substr(p_name, 3) ELSE p_name END"
VOCAB = "(SELECT word, count(*) AS freq FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word)"
WORDS = f"(SELECT DISTINCT unnest(string_split({TYPO}, ' ')) AS word FROM part)"


def _vocabulary(t):
    return t.part.select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def _typos(t):
    return t.part.select("p_partkey", F.expr("IF(p_partkey % 4 = 0, substr(p_name, 1, 1) || substr(p_name, 3), p_name)").alias("name"))


FIXES = f"""
WITH v AS {VOCAB}, u AS (SELECT word FROM {WORDS} WHERE word NOT IN (SELECT word FROM v) AND length(word) > 2),
r AS (SELECT u.word, v.word AS fixed, row_number() OVER (PARTITION BY u.word ORDER BY v.freq DESC, v.word) AS r FROM u JOIN v ON levenshtein(u.word, v.word) <= 1)
"""


@query("spelling_word_corrections", "V-8", FIXES + "SELECT word, fixed FROM r WHERE r = 1")
def spelling_words(t):
    words = _typos(t).select(F.explode(F.split("name", " ")).alias("word"))
    return V.word_corrections(words, _vocabulary(t))


@query("spelling_column", "V-8 V-9", FIXES + f""", n AS (SELECT p_partkey, {TYPO} AS name FROM part),
w AS (SELECT p_partkey, unnest(string_split(name, ' ')) AS word, unnest(range(0, len(string_split(name, ' ')))) AS i FROM n)
SELECT p_partkey, string_agg(coalesce(r.fixed, w.word), ' ' ORDER BY i) AS name FROM w LEFT JOIN r ON r.word = w.word AND r.r = 1 GROUP BY p_partkey""")
def spelling_column(t):
    return V.correct_spelling(_typos(t), "name", _vocabulary(t))


@query("standardize_column", "V-9", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' ELSE o_orderpriority END AS o_orderpriority FROM orders""")
def standardize_column(t):
    terms = V.distinct_terms(t.orders, "o_orderpriority")
    fixes = terms.where("term IN ('1-URGENT', '2-HIGH')").selectExpr("term", "lower(substr(term, 3)) AS fixed")
    return V.standardize_column(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", fixes)


@query("similar_term_pairs", "V-10", f"""
WITH n AS (SELECT DISTINCT {TYPO} AS term FROM part)
SELECT a.term AS a, b.term AS b FROM n a JOIN n b ON a.term <> b.term AND abs(length(a.term) - length(b.term)) <= 1
 AND (substr(b.term, 1, 1) || substr(b.term, 3) = a.term OR substr(a.term, 1, 1) || substr(a.term, 3) = b.term
  OR len(list_filter(range(1, length(a.term) + 1), lambda i: substr(a.term, 1, i - 1) || substr(a.term, i + 1) = b.term)) > 0
  OR len(list_filter(range(1, length(b.term) + 1), lambda i: substr(b.term, 1, i - 1) || substr(b.term, i + 1) = a.term)) > 0)
 AND 200.0 * least(length(a.term), length(b.term)) / (length(a.term) + length(b.term)) >= 92""")
def similar_term_pairs(t):
    terms = _typos(t).select(F.col("name").alias("term")).distinct()
    return fuzzy.similar_pairs(terms, 92).select("a", "b")


@query("similar_term_groups", "V-10")
def similar_term_groups(t):
    terms = _typos(t).groupBy(F.col("name").alias("term")).agg(F.min("p_partkey").alias("first"))
    return fuzzy.group_similar(terms, "first", 85)


@query("standard_terms", "V-11")
def standard_terms(t):
    terms = _typos(t).groupBy(F.col("name").alias("term")).agg(F.min("p_partkey").alias("first"))
    return fuzzy.standard_terms(terms, "first", _vocabulary(t), 85)


@query("majority_vote", "V-12", """
WITH v AS (SELECT p_name AS term, upper(p_type) AS code FROM part WHERE p_type <> 'SMALL'),
y AS (SELECT term, code, count(*) AS n FROM v GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY n DESC, code) AS r FROM y),
o AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY n DESC, term) AS k FROM b WHERE r = 1)
SELECT DISTINCT p_name AS term, coalesce(o.code, p_name) AS fixed FROM part LEFT JOIN o ON o.term = p_name AND o.k = 1""")
def majority_vote(t):
    responses = t.part.selectExpr("p_name AS term", "'Standardized term: \"' || p_type || '\" (size)' AS response")
    responses = responses.withColumn("response", F.regexp_replace("response", "Standardized term", "standardized term"))
    return V.majority_vote(responses, t.part.where("p_type = 'SMALL'").select("p_type"))


@query("clean_responses", "V-12", "SELECT p_partkey, p_name AS v FROM part")
def clean_responses(t):
    raw = F.expr("'The standard name for the \"' || p_name || '\" (part) [see list]-> '")
    return t.part.select("p_partkey", V.clean_response(raw).alias("v"))


@query("distinct_terms", "V-13", "SELECT DISTINCT trim(p_name) AS term FROM part WHERE trim(p_name) <> ''")
def distinct_terms(t):
    return V.distinct_terms(t.part, "p_name")


@query("standard_strings", "V-14", """
SELECT p_partkey, replace(replace(lower(trim(p_name)), ' ', '_'), '/', '_') AS p_name, lower(p_brand) AS p_brand FROM part""")
def standard_strings(t):
    return V.standard_strings(t.part.select("p_partkey", "p_name", "p_brand"))


@query("standardize_missing_text", "V-16", """
WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_type END AS p_type FROM part)
SELECT p_partkey, p_brand, CASE WHEN p_brand = 'Brand#1' THEN 'FIRST' ELSE coalesce(p_type,
  (SELECT p_type FROM p WHERE p_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) END AS p_type FROM p""")
def standardize_missing_text(t):
    df = t.part.selectExpr("p_partkey", "p_brand", "IF(p_partkey % 7 = 0, NULL, p_type) AS p_type")
    mapping = V.distinct_terms(t.part, "p_brand").where("term = 'Brand#1'").selectExpr("term", "'FIRST' AS fixed")
    return V.standardize_missing(df, "p_type", "p_brand", mapping)


@query("standardize_missing_number", "V-16", """
WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS price FROM part)
SELECT p_partkey, round(CASE WHEN p_brand = 'Brand#1' THEN 5 ELSE coalesce(price, (SELECT avg(price) FROM p)) END, 6) AS price FROM p""")
def standardize_missing_number(t):
    df = t.part.selectExpr("p_partkey", "p_brand", "IF(p_partkey % 7 = 0, NULL, p_retailprice) AS price")
    mapping = V.distinct_terms(t.part, "p_brand").where("term = 'Brand#1'").selectExpr("term", "'5' AS fixed")
    return V.standardize_missing(df, "price", "p_brand", mapping).select("p_partkey", F.round("price", 6).alias("price"))


_NAMES = {
    "underscore": ("CustomerName", "customer_name"), "camelize": ("customer_name", "CustomerName"),
    "dasherize": ("customer_name", "customer-name"), "humanize": ("customer_id", "Customer"),
    "titleize": ("customer_name", "Customer Name"), "singularize": ("categories", "category"),
    "pluralize": ("category", "categories"), "parameterize": ("Customer Name (full)", "customer-name-full"),
}
for _m, (_a, _b) in _NAMES.items():
    query(f"names_{_m}", "N-1", f'SELECT c_custkey AS key, c_name AS "{_b}" FROM customer'
          .replace("AS key", 'AS "Key"' if _m in ("camelize", "humanize", "titleize") else "AS keys" if _m == "pluralize" else "AS key"))(
        lambda t, m=_m, a=_a: N.inflect_columns(t.customer.selectExpr("c_custkey AS key", f"c_name AS `{a}`"), m))


@query("name_table", "N-2", """
SELECT column_name AS original, column_name AS inflected, CASE column_name WHEN 'c_name' THEN 'full_name' ELSE column_name END AS suggested FROM (DESCRIBE customer)""")
def name_table(t):
    return N.name_table(t.customer, "underscore", {"c_name": "full_name"})


@query("rename_from_table", "N-2", "SELECT s_suppkey, s_name AS full_name, s_nationkey, s_acctbal FROM supplier")
def rename_from_table(t):
    return N.rename_from_table(t.supplier, N.name_table(t.supplier, "underscore", {"s_name": "full_name"}), "suggested")


BOOKS = "(SELECT p_partkey, p_brand, replace(p_name, ' ', ', ') AS words FROM part)"


def _books(t):
    return t.part.selectExpr("p_partkey", "p_brand", "replace(p_name, ' ', ', ') AS words", "p_brand || ', ' || p_type AS tags")


@query("list_like_columns", "R-1", f"""
SELECT 'words' AS "column" FROM {BOOKS} WHERE contains(words, ',') GROUP BY 1 UNION ALL SELECT 'tags' FROM region WHERE r_regionkey = 0""")
def list_like_columns(t):
    return R.list_like_columns(_books(t))


@query("split_lists", "R-2", """
SELECT p_partkey, unnest(string_split(p_name, ' ')) AS words, tag AS tags FROM part, (SELECT unnest([0, 1]) AS i) x,
 LATERAL (SELECT CASE WHEN i = 0 THEN p_brand ELSE p_type END AS tag) y""")
def split_lists(t):
    return R.split_lists(_books(t).drop("p_brand"), ["words", "tags"])


@query("melt_columns", "R-3", """
SELECT s_suppkey, 'balance' AS "Item_Variable", s_acctbal AS "Value" FROM supplier UNION ALL SELECT s_suppkey, 'nation', s_nationkey::DOUBLE FROM supplier""")
def melt_columns(t):
    return R.melt(t.supplier.selectExpr("s_suppkey", "s_acctbal AS balance", "double(s_nationkey) AS nation"), ["balance", "nation"])


@query("join_melts", "R-4", """
WITH m AS (SELECT s_suppkey, s_acctbal AS amount FROM supplier UNION SELECT s_suppkey, 1.0 FROM supplier)
SELECT s_suppkey, amount, s_name FROM m JOIN (SELECT s_suppkey, s_name FROM supplier) USING (s_suppkey)""")
def join_melts(t):
    melted = R.melt(t.supplier.selectExpr("s_suppkey", "s_acctbal AS a", "1D AS b"), ["a", "b"], "kind_Variable", "amount")
    return R.join_melts(melted, t.supplier.select("s_suppkey", "s_name"), ["s_suppkey"], [])
