"""Registered queries: name -> (Spark callable, optional SQL for the same tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}


class Tables:
    """The given tables of one folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"


def query(name: str, covers: str, sql: str | None = None, rounded: str = "", digits: int = 6):
    """Register ``fn(t: Tables)``; ``covers`` names rows of the operator inventory.

    ``rounded`` names columns rounded on both sides, where sums may be added up in another order.
    """
    columns = rounded.split()

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        def run(spark: SparkSession, folder: str) -> DataFrame:
            df = fn(Tables(spark, folder))
            return df.withColumns({c: F.round(c, digits) for c in columns}) if columns else df

        QUERIES[name] = run
        COVERS[name] = covers
        if sql is not None and columns:
            cells = ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in columns)
            ORACLES[name] = f"SELECT * REPLACE ({cells}) FROM ({sql})"
        elif sql is not None:
            ORACLES[name] = sql
        return fn

    return register
