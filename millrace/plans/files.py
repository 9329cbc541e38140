"""Queries over readers and writers: each writes a given table and reads it back."""

from pyspark.sql import functions as F

from millrace.plans.registry import query
from millrace.session import scratch_path
from millrace.sources import readers, writers

CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"
CUSTOMER_TYPES = "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"


def _csv_round(t, encoding="utf-8", delimiter="comma", detect=True):
    path = scratch_path(t.spark, "csv")
    writers.write_csv(t.customer, path, encoding, delimiter)
    return readers.read_csv(
        t.spark, path, writers.DELIMITERS[delimiter], None if detect else encoding, CUSTOMER_TYPES
    )


@query("csv_read_utf8", "SRC-1 SNK-1", CUSTOMER)
def csv_utf8(t):
    return _csv_round(t)


@query("csv_read_utf16", "SRC-1 SNK-1", CUSTOMER)
def csv_utf16(t):
    return _csv_round(t, "utf-16")


@query("csv_read_latin1_text", "SRC-1 SNK-1",
       "SELECT doc_id, regexp_replace(text, '[^a-zA-Zéèàù ]', '', 'g') AS words FROM documents")
def csv_latin1(t):
    docs = t.documents.select("doc_id", F.regexp_replace("text", "[^a-zA-Zéèàù ]", "").alias("words"))
    path = scratch_path(t.spark, "csv")
    writers.write_csv(docs, path, "latin-1")
    back = readers.read_csv(t.spark, path, encoding="ISO-8859-1", schema="doc_id BIGINT, words STRING")
    return back.select("doc_id", F.coalesce("words", F.lit("")).alias("words"))


@query("csv_read_cp1252", "SRC-1 SNK-1", CUSTOMER)
def csv_cp1252(t):
    return _csv_round(t, "cp1252")


@query("tsv_read", "SRC-7 SNK-2", CUSTOMER)
def tsv(t):
    return _csv_round(t, delimiter="tab")


@query("delimited_semicolon", "SNK-2", CUSTOMER)
def semicolon(t):
    return _csv_round(t, delimiter="semicolon")


@query("delimited_space", "SNK-2", CUSTOMER)
def space(t):
    return _csv_round(t, delimiter="space")


NESTED = """
WITH a AS (
  SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus FROM orders
)
SELECT c.c_custkey AS cust, c.c_name AS who_name, c.c_nationkey AS "who_at.nation",
       a.o_orderkey AS orders_id, a.o_totalprice AS orders_total
FROM customer c LEFT JOIN a ON a.o_custkey = c.c_custkey
"""


def _nested(t):
    orders = t.orders.select("o_custkey", F.expr("named_struct('id', o_orderkey, 'total', o_totalprice) o"))
    c = t.customer.selectExpr(
        "c_custkey AS cust", "named_struct('name', c_name, 'at', named_struct('nation', c_nationkey)) AS who"
    )
    # At most a few dozen orders belong to one customer of the given tables.
    lists = orders.groupBy("o_custkey").agg(F.collect_list("o").alias("orders"))
    return c.join(lists, F.col("cust") == F.col("o_custkey"), "left").drop("o_custkey")


@query("json_flatten", "SRC-2 SRC-3 SNK-3", NESTED)
def json_flatten(t):
    path = scratch_path(t.spark, "json")
    nested = _nested(t)
    writers.write_json(nested, path)
    return readers.read_json(t.spark, path, schema=nested.schema)


@query("json_props_flatten", "SRC-2 SRC-3",
       "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k FROM events")
def props_flatten(t):
    parsed = t.events.select("event_id", F.from_json("props", "k BIGINT").alias("props"))
    return readers.flatten_nested(parsed)


@query("explode_parallel_lists", "SRC-4",
       """SELECT doc_id, unnest(string_split(lang, '')) AS letter, unnest(range(1, length(lang) + 1)) AS place
          FROM documents""")
def parallel(t):
    lists = t.documents.select(
        "doc_id", F.split("lang", "").alias("letter"),
        F.sequence(F.lit(1).cast("bigint"), F.length("lang").cast("bigint")).alias("place"),
    )
    return readers.explode_parallel(lists)


@query("parquet_step_read", "SRC-5 SNK-5", "SELECT * FROM part")
def parquet_round(t):
    path = scratch_path(t.spark, "parquet")
    writers.write_parquet(t.part, path)
    return readers.read_file(t.spark, path, "parquet")


@query("preview_first_rows", "SRC-6", """
SELECT 'region' AS tab, CAST(r_regionkey AS BIGINT) AS key FROM (SELECT *, row_number() OVER () rn FROM region) WHERE rn <= 3
UNION ALL SELECT 'part', p_partkey FROM (SELECT *, row_number() OVER () rn FROM part) WHERE rn <= 3
""")
def preview(t):
    rows = readers.preview_parquet(t.spark, [t.path("region"), t.path("part")], 3)
    key = F.coalesce(F.get_json_object("record", "$.r_regionkey"), F.get_json_object("record", "$.p_partkey"))
    return rows.select(F.regexp_extract("file", r"([a-z]+)\.parquet$", 1).alias("tab"), key.cast("bigint").alias("key"))


@query("preview_text_files", "SRC-6",
       "SELECT CAST(3 AS BIGINT) AS lines, CAST(1 AS BIGINT) AS headers, CAST(1 AS BIGINT) AS files FROM region LIMIT 1")
def preview_text(t):
    path = scratch_path(t.spark, "csv")
    writers.write_csv(t.region.coalesce(1), path)
    rows = readers.preview_files(t.spark, path, 3, "*.csv")
    return rows.agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("text") == "r_regionkey,r_name").alias("headers"),
        F.countDistinct("file").alias("files"),
    )


@query("json_write_records", "SNK-3", CUSTOMER)
def json_records(t):
    path = scratch_path(t.spark, "json")
    writers.write_json(t.customer, path)
    return t.spark.read.schema(CUSTOMER_TYPES).json(path)


@query("json_write_values", "SNK-3",
       """SELECT '[' || c_custkey || ',"' || c_name || '",' || c_nationkey || ',"' || c_mktsegment || '"]' AS value
          FROM customer""")
def json_values(t):
    path = scratch_path(t.spark, "json")
    writers.write_json(t.customer.drop("c_acctbal"), path, "values")
    return t.spark.read.text(path)


@query("json_write_index", "SNK-3",
       """SELECT '{"' || c_custkey || '":{"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}}' AS value
          FROM customer""")
def json_index(t):
    path = scratch_path(t.spark, "json")
    writers.write_json(t.customer.select("c_custkey", "c_name", "c_nationkey"), path, "index", "c_custkey")
    return t.spark.read.text(path)


@query("json_write_split", "SNK-3",
       """SELECT '{"columns":["c_name","c_nationkey"],"index":[' || c_custkey || '],"data":[["' || c_name || '",'
          || c_nationkey || ']]}' AS value FROM customer""")
def json_split(t):
    return writers.json_lines(t.customer.select("c_custkey", "c_name", "c_nationkey"), "split", "c_custkey")


@query("xml_write_read", "SNK-4", CUSTOMER)
def xml_round(t):
    path = scratch_path(t.spark, "xml")
    writers.write_xml(t.customer, path, "customer")
    return t.spark.read.format("xml").option("rowTag", "customer").schema(CUSTOMER_TYPES).load(path)
