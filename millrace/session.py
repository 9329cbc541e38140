"""Session helpers: a default session, the shared scratch folder, lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("millrace")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("MILLRACE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Temporary folders of local sessions without ``spark.checkpoint.dir``, by application; removed when Python ends.
_LOCAL_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of the machine; on a
    cluster an executor could not read what another one wrote there.
    """
    conf = spark.sparkContext.getConf()
    folder = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, _LOCAL_FOLDERS[app], ignore_errors=True)
    return _LOCAL_FOLDERS[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    A written table outlives the executors that made it, so a lost executor costs a
    re-read and never a recomputation of everything before.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hash_sample(df: DataFrame, key: Sequence[str], size: int, seed: int) -> DataFrame:
    """The ``size`` rows with the smallest key hash, in that order.

    A threshold on the hash first keeps little more than ``size`` rows of the whole table, so
    no task hands on ``size`` rows of its own.
    """
    rank = F.xxhash64(*key, F.lit(seed)).bitwiseAND(F.lit(2**63 - 1))
    ranked = df.withColumn("_rank", rank)
    n = df.count()
    if n > 2 * size:
        near = ranked.where(F.col("_rank") < F.lit(int(2**63 * min(1.0, (1.2 * size + 200) / n)) - 1))
        if near.count() >= size:
            ranked = near
    return ranked.orderBy("_rank", *key).limit(size).drop("_rank")
