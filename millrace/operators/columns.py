"""Projections, filters and edits of rows and columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from millrace.functions.along import ordered_exprs
from millrace.functions.expressions import column_expr
from millrace.ordered import with_position

# Dtype names a caller may use -> Spark types.
DTYPES = {
    "float64": "double", "float32": "float", "int32": "int", "int64": "bigint", "uint8": "smallint",
    "object": "string", "string": "string", "boolean": "boolean", "bool": "boolean",
    "datetime64[ns]": "timestamp_ntz", "timedelta64[ns]": "interval day to second",
    "category": "string", "period[M]": "date",
}
ORDER = "_ord"


def header_as_row(df: DataFrame, headers: Sequence[str]) -> DataFrame:
    """New column names; the old names become a row, marked ``_ord`` 0 (data rows: 1)."""
    if len(headers) != len(df.columns):
        raise ValueError("headers must match the number of columns")
    body = df.select(*[F.col(f"`{c}`").cast("string") for c in df.columns]).toDF(*headers)
    top = df.sparkSession.createDataFrame([tuple(df.columns)], ", ".join(f"`{h}` string" for h in headers))
    return top.withColumn(ORDER, F.lit(0)).unionByName(body.withColumn(ORDER, F.lit(1)))


def set_headers(df: DataFrame, headers: Sequence[str]) -> DataFrame:
    if len(headers) != len(df.columns):
        raise ValueError("headers must match the number of columns")
    return df.toDF(*headers)


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename columns; unknown sources and names already taken raise."""
    missing = [c for c in names if c not in df.columns]
    kept = set(df.columns) - set(names)
    clash = [n for n in names.values() if n in kept]
    if missing or clash or len(set(names.values())) < len(names):
        raise ValueError(f"cannot rename: unknown {missing}, taken {clash}")
    return df.withColumnsRenamed(dict(names))


def assign_dtypes(df: DataFrame, dtypes: Mapping[str, str], strict: bool = True) -> DataFrame:
    """Cast columns; a bad value raises, or becomes NULL when not ``strict``."""
    changed = {}
    for c, name in dtypes.items():
        kind = DTYPES.get(name, name)
        cast = F.col(c).cast if strict else F.col(c).try_cast
        changed[c] = F.trunc(cast("timestamp_ntz"), "month") if name == "period[M]" else cast(kind)
    return df.withColumns(changed)


def infer_dtypes(df: DataFrame, share: float = 0.9) -> DataFrame:
    """String columns become numeric, else timestamps, when over ``share`` of all rows parse."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, StringType)]
    if not texts:
        return df
    row = df.selectExpr("count(*) n", *[
        x for i, c in enumerate(texts) for x in (
            f"count(try_cast(`{c}` AS double)) d{i}", f"count(try_cast(`{c}` AS timestamp_ntz)) t{i}",
        )
    ]).first()
    casts = {}
    for i, c in enumerate(texts):
        if row["n"] and row[f"d{i}"] / row["n"] > share:
            casts[c] = F.col(c).try_cast("double")
        elif row["n"] and row[f"t{i}"] / row["n"] > share:
            casts[c] = F.col(c).try_cast("timestamp_ntz")
    return df.withColumns(casts) if casts else df


def _valued(df: DataFrame, expression: str | Column, order_by: Sequence[str], series: Sequence[str]) -> tuple[DataFrame, Column]:
    """The expression as a column of a table that may have helper columns."""
    if not isinstance(expression, str):
        return df, expression
    if not order_by:
        return df, column_expr(expression, df)
    wide, (value,) = ordered_exprs(df, [expression], order_by, series)
    return wide, value


def add_computed(
    df: DataFrame, name: str, expression: str | Column, at: int | None = None,
    before: str | None = None, after: str | None = None, order_by: Sequence[str] = (), series: Sequence[str] = (),
) -> DataFrame:
    """A computed column at the end, at an index, or next to a column.

    Here and below ``order_by`` (a total order, within ``series``) lets the expression look along it: ``x.shift(1)``, ``x.cumsum()``.
    """
    if name in df.columns:
        raise ValueError(f"column {name} exists")
    wide, value = _valued(df, expression, order_by, series)
    cols = list(df.columns)
    place = at if at is not None else cols.index(before) if before else cols.index(after) + 1 if after else len(cols)
    if not 0 <= place <= len(cols):
        raise ValueError("position outside the table")
    cells = [F.col(f"`{c}`") for c in cols]
    return wide.select(*cells[:place], value.alias(name), *cells[place:])


def add_many_computed(df: DataFrame, expressions: Mapping[str, str], order_by: Sequence[str] = (), series: Sequence[str] = ()) -> DataFrame:
    """Computed columns at the end; those that look along the order share their passes over it."""
    if set(expressions) & set(df.columns):
        raise ValueError(f"columns exist: {sorted(set(expressions) & set(df.columns))}")
    wide, values = ordered_exprs(df, list(expressions.values()), order_by, series)
    return wide.select(*[F.col(f"`{c}`") for c in df.columns], *[v.alias(n) for n, v in zip(expressions, values)])


def select_columns(
    df: DataFrame, names: Sequence[str] | None = None, index_range: tuple[int, int] | None = None,
    reference: str | None = None, side: str = "both", include_reference: bool = True,
) -> DataFrame:
    """Columns by name, by inclusive index range, or left / right / both of a column."""
    cols = df.columns
    if names is not None:
        chosen = list(names)
    elif index_range is not None:
        chosen = cols[index_range[0]: index_range[1] + 1]
    else:
        at = cols.index(reference)
        left, right = cols[:at], cols[at + 1:]
        own = [reference] if include_reference else []
        chosen = {"left": left + own, "right": own + right, "both": left + own + right}[side]
    return df.select(*[F.col(f"`{c}`") for c in chosen])


def row_intervals(df: DataFrame, ranges: Sequence[tuple[int, int]], order_by: Sequence[str]) -> DataFrame:
    """Rows of inclusive position ranges along ``order_by``; a range past the end raises."""
    n = df.count()
    if any(not 0 <= a <= b < n for a, b in ranges):
        raise ValueError("invalid row range")
    pos = with_position(df, order_by, name="_pos")
    hit = reduce(lambda x, y: x | y, [F.col("_pos").between(a, b) for a, b in ranges])
    return pos.where(hit).drop("_pos")


def keep_rows(df: DataFrame, condition: str | Column, order_by: Sequence[str] = (), series: Sequence[str] = ()) -> DataFrame:
    wide, test = _valued(df, condition, order_by, series)
    return wide.where(test).select(*[F.col(f"`{c}`") for c in df.columns]) if order_by else wide.where(test)


def delete_rows(df: DataFrame, condition: str | Column, order_by: Sequence[str] = (), series: Sequence[str] = ()) -> DataFrame:
    """Rows where the condition is true go; rows where it is unknown stay."""
    wide, test = _valued(df, condition, order_by, series)
    return keep_rows(wide, ~F.coalesce(test, F.lit(False))).select(*[F.col(f"`{c}`") for c in df.columns])


def delete_keys(df: DataFrame, keys: DataFrame, on: Sequence[str], check: bool = True) -> DataFrame:
    """Drop the rows whose key is listed; a listed key that does not exist raises."""
    if check and keys.join(df.select(*on), list(on), "left_anti").limit(1).count():
        raise ValueError("unknown key in the list of rows to delete")
    return df.join(keys.select(*on), list(on), "left_anti")


def fetch_keys(df: DataFrame, keys: DataFrame, on: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    found = df.join(keys.select(*on), list(on), "left_semi")
    return found.select(*on, *[c for c in columns if c not in on]) if columns else found


def delete_columns(df: DataFrame, columns: Sequence[str | int]) -> tuple[DataFrame, list]:
    """Drop columns by name or index; also returns the entries that do not exist."""
    names = {i: c for i, c in enumerate(df.columns)} | {c: c for c in df.columns}
    invalid = [c for c in columns if c not in names]
    return df.drop(*[names[c] for c in columns if c in names]), invalid


def _replaced(c: str, how: str, pattern: str, new: str) -> tuple[Column, Column]:
    cell, pat = F.col(f"`{c}`"), F.lit(pattern)
    n = len(pattern)
    if how == "contains":
        return F.contains(cell, pat), F.replace(cell, pat, F.lit(new))
    if how == "starts":
        return F.startswith(cell, pat), F.concat(F.lit(new), F.substr(cell, F.lit(n + 1)))
    if how == "ends":
        return F.endswith(cell, pat), F.concat(F.substr(cell, F.lit(1), F.length(cell) - n), F.lit(new))
    if how == "regex":
        return cell.rlike(pattern), F.regexp_replace(cell, pattern, new)
    raise ValueError(f"unknown pattern type {how}")


def replace_pattern(
    df: DataFrame, how: str, pattern: str, new: str = "", columns: Sequence[str] | None = None
) -> DataFrame:
    """Replace matches in string columns; an empty replacement makes the cell NULL."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, StringType)]
    cells = {}
    for c in columns or texts:
        if c in texts:
            hit, value = _replaced(c, how, pattern, new)
            cells[c] = F.when(hit, F.lit(None) if new == "" else value).otherwise(F.col(f"`{c}`"))
    return df.withColumns(cells) if cells else df


def count_pattern(df: DataFrame, how: str, pattern: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: the number of cells ``replace_pattern`` would change."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, StringType)]
    hits = [F.count_if(_replaced(c, how, pattern, "")[0]) for c in columns or texts if c in texts]
    return df.agg(reduce(lambda a, b: a + b, hits, F.lit(0).cast("bigint")).alias("cells_modified"))


def rows_with_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))


def head(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def tail(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in order_by]).limit(n)


def square_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}_Squared": F.col(c) * F.col(c) for c in columns})


def clean_currency(c: str | Column, kind: str = "double") -> Column:
    """``$1,234.50`` -> number."""
    return F.regexp_replace(c, "[$,]", "").cast(kind)


def clean_sales_sheet(df: DataFrame, money: Mapping[str, str], date: str | None = None,
                      date_format: str = "M/d/yyyy") -> DataFrame:
    """Money columns to numbers, renamed with ``($)``; the invoice date parsed."""
    out = df.withColumns({c: clean_currency(c, kind) for c, kind in money.items()})
    if date:
        out = out.withColumn(date, F.to_date(date, date_format))
    return out.withColumnsRenamed({c: f"{c} ($)" for c in money})


def in_year(df: DataFrame, column: str, year: int) -> DataFrame:
    """Rows of one year, as a range so that the scan can skip files and row groups."""
    kind = df.schema[column].dataType.simpleString()
    first, after = (F.lit(f"{y:04d}-01-01").cast(kind) for y in (year, year + 1))
    return df.where((F.col(column) >= first) & (F.col(column) < after))


def apply_edits(df: DataFrame, edits: DataFrame, key: Sequence[str]) -> DataFrame:
    """Write back human edits given as rows (key..., column, value as text).

    Edits are pivoted to one row per key, so the table is joined once.
    """
    targets = [c for c in df.columns if c not in key]
    wide = edits.groupBy(*key).agg(*[
        x for c in targets for x in (
            F.max(F.when(F.col("column") == c, F.col("value"))).alias(f"_e_{c}"),
            F.count_if(F.col("column") == c).alias(f"_n_{c}"),
        )
    ])
    return df.join(wide, list(key), "left").select(*[
        F.col(c) if c in key else
        F.when(F.col(f"_n_{c}") > 0, F.col(f"_e_{c}").cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c)
        for c in df.columns
    ])


def distinct_rows(df: DataFrame, key: Sequence[str] | None = None) -> DataFrame:
    """Drop exact duplicates (of all columns but the key); the smallest key is kept.

    A grouped ``min`` combines copies map-side, so one row with very many copies does
    not become one large task.
    """
    if key is None:
        return df.dropDuplicates()
    body = [c for c in df.columns if c not in key]
    return df.groupBy(*body).agg(F.min(F.struct(*key)).alias("_k")).select(
        *[F.col(f"_k.{c}").alias(c) if c in key else F.col(c) for c in df.columns]
    )


def duplicate_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: rows, duplicate rows (copies beyond the first) and the de-dup ratio.

    The ratio is 1 without duplicates, else duplicates / rows (more duplicates score higher).
    """
    counts = df.groupBy(*(columns or df.columns)).count()
    n, extra = F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.sum(F.col("count") - 1), F.lit(0))
    return counts.agg(n.alias("rows"), extra.alias("duplicates")).withColumn(
        "dedup_ratio", F.when(F.col("duplicates") == 0, F.lit(1.0)).otherwise(F.col("duplicates") / F.col("rows"))
    )


def lookup(df: DataFrame, column: str, mapping: DataFrame, key: str, value: str, limit: int = 1_000_000) -> DataFrame:
    """Map values through a two-column table; unmapped values stay.

    Equal values are counted as one by joining on the value; the mapping is broadcast only
    when a count shows it is small. Beyond that Spark shuffles, and AQE splits hot values.
    """
    side = mapping.select(F.col(key).alias("_key"), F.col(value).alias("_val"))
    if side.limit(limit + 1).count() <= limit:
        side = F.broadcast(side)
    kind = df.schema[column].dataType
    return df.join(side, F.col(column) == F.col("_key"), "left").select(*[
        F.coalesce(F.col("_val").cast(kind), F.col(c)).alias(c) if c == column else F.col(c) for c in df.columns
    ])


def attach(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Put the columns of two tables side by side, by key."""
    return left.join(right, list(key), "full_outer")
