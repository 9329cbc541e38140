"""Queries over saved steps and step lists."""

from pyspark.sql import functions as F

from millrace.operators import columns as C
from millrace.operators import missing as M
from millrace.operators import scale as Z
from millrace.operators import values as V
from millrace.operators.steps import StepStore, run_steps
from millrace.plans.columns import HOLED_CUSTOMER, holed_customer
from millrace.plans.registry import query
from millrace.session import scratch_path

# The steps an accepted list may name.
STEPS = {
    "drop_duplicates": C.distinct_rows,
    "fill_missing": lambda df, column, process: M.fix_missing(df, column, process)[0],
    "standard_strings": V.standard_strings,
    "scale": lambda df, columns, method: Z.normalise(df, columns, method)[0],
    "delete_rows": C.delete_rows, "delete_columns": lambda df, columns: C.delete_columns(df, columns)[0],
}


def _store(t):
    store = StepStore(t.spark, scratch_path(t.spark, "steps"))
    raw = holed_customer(t).withColumn("c_acctbal", F.col("c_acctbal").cast("string"))
    store.save(raw, "raw data")
    store.save(M.fix_missing(store.load(), "c_acctbal", "median")[0], "Fill: Missing", "missing")
    store.save(store.load().drop("c_name"), "zz drop name")
    return store


@query("step_save_infers_types", "K-1 P-4 SRC-5", f"SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM {HOLED_CUSTOMER}")
def step_save(t):
    store = StepStore(t.spark, scratch_path(t.spark, "steps"))
    raw = t.customer.withColumn("c_acctbal", F.expr("IF(c_custkey % 7 = 0, NULL, string(c_acctbal))"))
    store.save(raw.withColumn("c_acctbal", F.coalesce("c_acctbal", F.lit("0"))), "raw data")
    return store.load("raw_data").withColumn("c_acctbal", F.expr("IF(c_custkey % 7 = 0, NULL, c_acctbal)"))


@query("step_list", "K-2", """
SELECT unnest(['raw_data', 'fill_missing', 'zz_drop_name']) AS step, unnest([5, 5, 4]) AS n_columns FROM customer WHERE c_custkey = 0""")
def step_list(t):
    return _store(t).steps().select("step", "n_columns")


@query("step_summary", "K-2", "SELECT CAST(3 AS BIGINT) AS n_steps, 'raw_data' AS first_step, 'zz_drop_name' AS last_step FROM customer WHERE c_custkey = 0")
def step_summary(t):
    return _store(t).summary()


@query("step_reset", "K-3", f"SELECT c_custkey, c_name FROM customer")
def step_reset(t):
    store = _store(t)
    store.reset_to("fill_missing")
    return store.load().select("c_custkey", "c_name")


ACCEPTED = [
    ("fill_missing", {"column": "c_acctbal", "process": "median"}), ("standard_strings", {}),
    ("scale", {"columns": ["c_acctbal"], "method": "minmax_scaler"}), ("delete_columns", {"columns": ["c_nationkey"]}),
]


@query("run_step_list", "K-4 K-5", f"""
WITH f AS (SELECT c_custkey, c_name, c_mktsegment, coalesce(c_acctbal, (SELECT median(c_acctbal) FROM {HOLED_CUSTOMER})) AS b FROM {HOLED_CUSTOMER})
SELECT c_custkey, lower(c_name) AS c_name, lower(c_mktsegment) AS c_mktsegment, round((b - (SELECT min(b) FROM f)) / (SELECT max(b) - min(b) FROM f), 6) AS c_acctbal FROM f""")
def run_step_list(t):
    return run_steps(holed_customer(t), ACCEPTED, STEPS).withColumn("c_acctbal", F.round("c_acctbal", 6))


@query("run_step_list_skipping", "K-4", "SELECT c_custkey, lower(c_mktsegment) AS c_mktsegment FROM customer")
def run_step_list_skipping(t):
    steps = [("fill_missing", {"column": "not_there", "process": "mean"}), ("standard_strings", {})]
    return run_steps(t.customer.select("c_custkey", "c_mktsegment"), steps, STEPS, on_error="skip")
