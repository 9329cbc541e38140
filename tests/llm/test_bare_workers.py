"""Corpus operators on workers that hold no copy of the package."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
RUN = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from millrace.llm import decontaminate, html, packing, queries, resample, substrings
docs = spark.createDataFrame([(i, " ".join("w%d" % (i * j % 50) for j in range(60))) for i in range(20)], "doc_id long, text string")
items = docs.limit(2).withColumnRenamed("doc_id", "item_id")
pages = spark.createDataFrame([(1, "u", "<html><body><article><p>Some text.</p></article></body></html>")], "page_id long, url string, html string")
assert substrings.deduplicated(docs).count() == 20
assert decontaminate.matches(docs, items).count() >= 2 and decontaminate.clean(docs, items).count() <= 18
assert html.extracted(pages).first()["text"] == "Some text."
assert packing.packed(docs, queries.vocabulary()).count() >= 20
assert resample.resampled(docs, items).count() == 20
print("DONE")
"""


def test_operators_run_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_CONF_DIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", RUN.format(repo=REPO)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "DONE" in done.stdout, done.stderr[-3000:]
