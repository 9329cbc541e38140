"""Named steps: saved tables, a step log, and running a list of steps."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.operators.columns import infer_dtypes

LOG_SCHEMA = "step_order bigint, step string, path string, agent string, columns string, n_columns int, saved_at timestamp"
log = logging.getLogger(__name__)


class StepStore:
    """Steps under one folder every executor can reach: a Parquet table each, and a log.

    The log is append-only. Resetting appends a marker row, so no table is ever changed while
    something may still read it.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._log = f"{self.folder}/_steps"

    def _entries(self) -> DataFrame:
        try:
            return self.spark.read.schema(LOG_SCHEMA).parquet(self._log)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], LOG_SCHEMA)
            raise

    def _append(self, order: int, step: str, path: str, agent: str, columns: Sequence[str]) -> None:
        row = (order, step, path, agent, ",".join(columns), len(columns), datetime.now(timezone.utc))
        self.spark.createDataFrame([row], LOG_SCHEMA).coalesce(1).write.mode("append").parquet(self._log)

    def save(self, df: DataFrame, step: str, agent: str = "", infer: bool = True) -> str:
        """Write a step: name made safe, types inferred, table and log row written."""
        name = re.sub(r"[^A-Za-z0-9_]+", "_", step).strip("_").lower()
        df = infer_dtypes(df) if infer else df
        order = (self._entries().agg(F.max("step_order")).first()[0] or 0) + 1
        path = f"{self.folder}/{order:05d}_{name}"
        df.write.option("compression", "snappy").parquet(path)
        self._append(order, name, path, agent, df.columns)
        return name

    def steps(self) -> DataFrame:
        """The current steps in order: the last save per name, after resets."""
        return self.spark.createDataFrame(self._current(), LOG_SCHEMA)

    def _current(self) -> list:
        live: dict[str, tuple] = {}
        for r in sorted(self._entries().collect(), key=lambda r: r["step_order"]):  # one short row per save
            if r["path"]:
                live.pop(r["step"], None)
                live[r["step"]] = r
            else:  # a reset: steps after the named one are gone
                names = list(live)
                live = {n: live[n] for n in names[: names.index(r["step"]) + 1]}
        return list(live.values())

    def load(self, step: str | None = None) -> DataFrame:
        """A step's table; the latest one when no name is given."""
        rows = self._current()
        if not rows:
            raise LookupError("no step is saved")
        found = rows[-1] if step is None else next((r for r in rows if r["step"] == step), None)
        if found is None:
            raise LookupError(f"no step {step}")
        return self.spark.read.parquet(found["path"])

    def info(self, step: str) -> DataFrame:
        return self.steps().where(F.col("step") == step)

    def summary(self) -> DataFrame:
        """One row: number of steps, first and last step."""
        return self.steps().agg(
            F.count(F.lit(1)).alias("n_steps"), F.min_by("step", "step_order").alias("first_step"),
            F.max_by("step", "step_order").alias("last_step"))

    def reset_to(self, step: str) -> None:
        """Later steps (by order saved) no longer count; their tables stay readable."""
        if step not in [r["step"] for r in self._current()]:
            raise LookupError(f"no step {step}")
        order = self._entries().agg(F.max("step_order")).first()[0] + 1
        self._append(order, step, "", "reset", [])


def run_steps(df: DataFrame, steps: Sequence[tuple[str, dict]], registry: dict[str, Callable[..., DataFrame]],
              on_error: str = "fail") -> DataFrame:
    """Apply (name, parameters) in order; ``on_error`` = skip leaves out a step that fails.

    Steps that only fail when data is read are not seen here: they fail at the action.
    """
    for name, params in steps:
        try:
            df = df.transform(registry[name], **params)
        except Exception as e:
            if on_error != "skip":
                raise
            log.warning("step %s skipped: %s", name, e)
    return df
