"""First normal form: find, split and melt repeating values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType


def list_like_columns(df: DataFrame) -> DataFrame:
    """(column): string columns with a comma in any value."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, StringType)]
    rows = ", ".join(f"named_struct('column', '{c}', 'hit', max(contains(`{c}`, ',')))" for c in texts)
    return df.selectExpr(f"array({rows}) AS s").selectExpr("inline(s)").where("hit").select("column")


def split_lists(df: DataFrame, columns: Sequence[str], separator: str = ", ") -> DataFrame:
    """One row per list element, column after column (cross product); NULL stays one row."""
    for c in columns:
        pattern = "\\Q" + separator + "\\E"
        df = df.withColumn(c, F.explode_outer(F.split(F.col(c), pattern)))
    return df


def melt(df: DataFrame, columns: Sequence[str], variable: str = "Item_Variable", value: str = "Value") -> DataFrame:
    """Repeating columns to rows; the other columns identify them."""
    return df.unpivot([c for c in df.columns if c not in columns], list(columns), variable, value)


def join_melts(melted: DataFrame, earlier: DataFrame | None, key: Sequence[str], used: Sequence[str]) -> DataFrame:
    """De-duplicate a melt, put it beside an earlier one by key, drop used and variable columns."""
    out = melted.dropDuplicates()
    if earlier is not None:
        own = set(out.columns)
        out = out.join(earlier.select(*key, *[c for c in earlier.columns if c not in own]), list(key), "full_outer")
    return out.drop(*used, *[c for c in out.columns if c.endswith("_Variable")])
