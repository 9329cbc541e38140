"""Comparing tables row by row through their key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType


def _paired(a: DataFrame, b: DataFrame, key: Sequence[str], columns: Sequence[str], how: str = "full_outer") -> DataFrame:
    left = a.select(*key, F.struct(*[F.col(c) for c in columns]).alias("a"), F.lit(True).alias("_in_a"))
    right = b.select(*key, F.struct(*[F.col(c) for c in columns]).alias("b"), F.lit(True).alias("_in_b"))
    return left.join(right, list(key), how)


def compare_columns(a: DataFrame, b: DataFrame, column_a: str, column_b: str, key: Sequence[str],
                    null_safe: bool = True) -> DataFrame:
    """One row: total, matches, accuracy (%). Tables whose keys differ raise.

    ``null_safe``: two missing values match (column mode); else they do not (row mode).
    """
    left = a.select(*key, F.col(column_a).alias("_a"), F.lit(1).alias("_in_a"))
    right = b.select(*key, F.col(column_b).alias("_b"), F.lit(1).alias("_in_b"))
    both = left.join(right, list(key), "full_outer")
    hit = F.col("_a").eqNullSafe(F.col("_b")) if null_safe else F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))
    lone = F.count_if(F.col("_in_a").isNull() | F.col("_in_b").isNull())
    return both.agg(F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("matches"), lone.alias("_lone")).select(
        F.when(F.col("_lone") > 0, F.raise_error(F.lit("the tables have different rows"))).otherwise(F.col("total")).alias("total"),
        "matches", F.round(F.col("matches") * 100 / F.col("total"), 2).alias("accuracy"))


def mismatches(a: DataFrame, b: DataFrame, column_a: str, column_b: str, key: Sequence[str], null_safe: bool = True) -> DataFrame:
    """(key..., value_a, value_b) of rows that differ."""
    both = a.select(*key, F.col(column_a).alias("value_a")).join(
        b.select(*key, F.col(column_b).alias("value_b")), list(key), "full_outer")
    x, y = F.col("value_a"), F.col("value_b")
    return both.where(~(x.eqNullSafe(y) if null_safe else F.coalesce(x == y, F.lit(False))))


def cell_accuracy(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: the share (%) of equal cells over the shared columns, 0 without any."""
    shared = [c for c in a.columns if c in b.columns and c not in key]
    if not shared:
        return a.limit(0).agg(F.coalesce(F.max(F.lit(0.0)), F.lit(0.0)).alias("accuracy"))
    both = _paired(a, b, key, shared, "inner")
    hits = reduce(lambda x, y: x + y, [F.count_if(F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))) for c in shared])
    return both.agg(F.round(hits * 100 / (F.count(F.lit(1)) * len(shared)), 2).alias("accuracy"))


def review_accuracy(original: DataFrame, machine: DataFrame, human: DataFrame, key: Sequence[str],
                    columns: Sequence[str]) -> DataFrame:
    """(column, original, machine, human): share (%) of cells equal to the human value, and means."""
    cells = lambda tag: [F.col(c).alias(f"{tag}_{c}") for c in columns]
    three = human.select(*key, *cells("h")).join(original.select(*key, *cells("o")), list(key), "left").join(
        machine.select(*key, *cells("m")), list(key), "left")
    rows = ", ".join(
        f"named_struct('column', '{c}', 'original', avg(double(o_{c} <=> h_{c})) * 100, "
        f"'machine', avg(double(m_{c} <=> h_{c})) * 100, 'human', 100D)" for c in columns
    )
    per = three.selectExpr(f"array({rows}) AS s").selectExpr("inline(s)")
    total = per.agg(F.lit("overall").alias("column"), *[F.avg(c).alias(c) for c in ("original", "machine", "human")])
    return per.unionByName(total)


def standardisation_accuracy(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: 1 - changed cells / cells."""
    columns = [c for c in before.columns if c not in key]
    both = _paired(before, after, key, columns, "inner")
    changed = reduce(lambda x, y: x + y, [F.count_if(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))) for c in columns])
    return both.agg((1 - changed / (F.count(F.lit(1)) * len(columns))).alias("accuracy"))


def tables_match(a: DataFrame, b: DataFrame, key: Sequence[str], rtol: float = 1e-6, atol: float = 1e-6) -> DataFrame:
    """(check, ok): same names, same rows, numbers close (missing = 0), text equal (missing = '')."""
    spark = a.sparkSession
    names = spark.createDataFrame([("names", a.columns == b.columns)], "check string, ok boolean")
    shared = [c for c in a.columns if c in b.columns and c not in key]
    both = _paired(a, b, key, shared)

    def same(c: str) -> Column:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        if isinstance(a.schema[c].dataType, NumericType):
            x, y = F.coalesce(x.cast("double"), F.lit(0.0)), F.coalesce(y.cast("double"), F.lit(0.0))
            return F.abs(x - y) <= atol + rtol * F.abs(y)
        return F.coalesce(x.cast("string"), F.lit("")) == F.coalesce(y.cast("string"), F.lit(""))

    checks = {"rows": F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull(), **{c: same(c) for c in shared}}
    wide = both.agg(*[F.min(v).alias(c) for c, v in checks.items()])
    return names.unionByName(wide.unpivot([], list(checks), "check", "ok"))
