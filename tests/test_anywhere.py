"""The library runs where nothing is set up: no shared folder named, no copy of the package on the workers."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
RUN = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate())
{body}
print("DONE")
"""


def run_elsewhere(tmp_path, body):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    env["SPARK_CONF_DIR"] = str(tmp_path)  # no defaults of this machine
    done = subprocess.run([sys.executable, "-c", RUN.format(repo=REPO, body=body)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "DONE" in done.stdout, done.stderr[-3000:]
    return done.stdout


def test_lineage_is_cut_without_a_named_folder(tmp_path):
    out = run_elsewhere(tmp_path, """
import os
from millrace.session import cut_lineage, shared_dir
assert cut_lineage(spark.range(3)).count() == 3 and shared_dir(spark) == shared_dir(spark)
print("FOLDER", shared_dir(spark))
""")
    folder = out.split("FOLDER ")[1].split()[0]
    assert not os.path.exists(folder)  # gone with the process


def test_detectors_run_without_the_package_on_workers(tmp_path):
    run_elsewhere(tmp_path, """
from millrace.operators import anomaly
df = spark.range(200).selectExpr("id", "double(id % 17) AS x")
assert anomaly.detect(df, ["id"], ["x"], ["LOF", "IForest"]).count() == 400
""")
