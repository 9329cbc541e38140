"""Missing data: reports, fills, interpolation, imputation models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import (
    DateType, FractionalType, IntegralType, NumericType, StringType, TimestampNTZType, TimestampType,
)

from millrace import ordered
from millrace.quantiles import column_modes, column_quantiles, literal
from millrace.operators.neighbours import nearest
from millrace.session import cut_lineage, hash_sample

# Words that count as missing, and the default replacements.
MISSING_WORDS = ("nan", "NaN", "None", "NULL")
NUMERIC_FILL, TEXT_FILL = 9999, "NA"


def blank_to_null(df: DataFrame) -> DataFrame:
    """Blanks and missing-words of string columns, and NaN of doubles, become NULL."""
    cells = {}
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, StringType):
            cells[f.name] = F.when(~(c.rlike(r"^\s*$") | c.isin(*MISSING_WORDS)), c)
        elif isinstance(f.dataType, FractionalType) and f.dataType.typeName() != "decimal":
            cells[f.name] = F.nanvl(c, F.lit(None).cast(f.dataType))
    return df.withColumns(cells) if cells else df


def missing_report(df: DataFrame) -> DataFrame:
    """(column, missing, pct) for columns with any missing value, in one pass."""
    clean = blank_to_null(df)
    rows = ", ".join(
        f"named_struct('column', '{c}', 'missing', count(*) - count(`{c}`), "
        f"'pct', round((count(*) - count(`{c}`)) * 100D / count(*), 2))" for c in df.columns
    )
    return clean.selectExpr(f"array({rows}) AS s").selectExpr("inline(s)").where("missing > 0")


def _fill(df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), v) for c, v in values.items()})


def _is(df: DataFrame, column: str, *kinds: type) -> bool:
    return isinstance(df.schema[column].dataType, kinds)


def fix_missing(
    df: DataFrame, column: str, process: str, custom=None, order_by: Sequence[str] | None = None,
    series: Sequence[str] = (), method: str = "exact",
) -> tuple[DataFrame, str]:
    """Fill one column; returns the table and a sentence saying what was done.

    ``process``: replace, custom_text, custom_number, custom_date, mean, median, mode,
    ffill, bfill, interpolate. A method that does not fit the column's type leaves it as is.
    """
    kind = df.schema[column].dataType
    lit = lambda v: literal(v, kind)
    numeric = _is(df, column, NumericType)
    if process == "replace":
        value = NUMERIC_FILL if numeric else TEXT_FILL
        if not numeric and not _is(df, column, StringType):
            return df, f"{column}: replace needs a number or text column"
        return _fill(df, {column: lit(value)}), f"{column}: missing values set to {value}"
    if process == "custom_text":
        if not _is(df, column, StringType):
            return df, f"{column}: custom_text needs a text column"
        c = F.col(column)
        blank = c.isNull() | c.isin("nan", "NaN", "None")
        return df.withColumn(column, F.when(blank, F.lit(custom)).otherwise(c)), f"{column}: set to {custom!r}"
    if process == "custom_number":
        if not numeric:
            return df, f"{column}: custom_number needs a number column"
        value = int(custom) if _is(df, column, IntegralType) else custom
        return _fill(df, {column: lit(value)}), f"{column}: set to {value}"
    if process == "custom_date":
        if not _is(df, column, DateType, TimestampType, TimestampNTZType):
            return df, f"{column}: custom_date needs a date column"
        return _fill(df, {column: lit(custom)}), f"{column}: set to {custom}"
    if process in ("mean", "median"):
        if not numeric:
            return df, f"{column}: {process} needs a number column"
        value = (df.agg(F.avg(column)).first()[0] if process == "mean"
                 else column_quantiles(df, [column], [0.5], method)[column][0])
        if value is None:
            return df, f"{column}: no values"
        # The average of an integer column is a fraction: the column becomes double.
        cell = F.coalesce(F.col(column).cast("double"), F.lit(value))
        return df.withColumn(column, cell), f"{column}: set to the {process} {value}"
    if process == "mode":
        value = column_modes(df, [column])[column]
        return (df if value is None else _fill(df, {column: lit(value)})), f"{column}: set to the mode {value}"
    if process in ("ffill", "bfill"):
        return fill_along(df, [column], process, order_by, series), f"{column}: {process}"
    if process == "interpolate":
        return interpolate(df, column, order_by, series), f"{column}: linear interpolation"
    raise ValueError(f"unknown process {process}")


def fill_along(df: DataFrame, columns: Sequence[str], process: str, order_by: Sequence[str],
               series: Sequence[str] = ()) -> DataFrame:
    """Last (``ffill``) or next (``bfill``) known value along ``order_by``."""
    if not order_by:
        raise ValueError("order_by is needed: rows have no order of their own")
    names = {c: f"_fill_{c}" for c in columns}
    filled = ordered.fill_along(
        df, columns, order_by, series, **{"forward" if process == "ffill" else "backward": names}
    )
    return filled.select(*[F.col(names[c]).alias(c) if c in names else F.col(c) for c in df.columns])


def interpolate(df: DataFrame, column: str, order_by: Sequence[str], series: Sequence[str] = ()) -> DataFrame:
    """Linear by row position; leading gaps stay, trailing gaps take the last value."""
    if not order_by:
        raise ValueError("order_by is needed: rows have no order of their own")
    small = ordered.is_small(df, series)
    pos = ordered.with_position(df, order_by, series, "_at", small)
    known = F.when(F.col(column).isNotNull(), F.struct(F.col("_at"), F.col(column).cast("double").alias("v")))
    pos = pos.withColumn("_known", known)
    pos = ordered.fill_along(
        pos if small else cut_lineage(pos), ["_known"], ["_at"], series,
        forward={"_known": "_prev"}, backward={"_known": "_next"}, small=small,
    )
    slope = (F.col("_next.v") - F.col("_prev.v")) / F.nullif(F.col("_next._at") - F.col("_prev._at"), F.lit(0))
    value = F.when(F.col(column).isNotNull(), F.col(column).cast("double")).when(
        F.col("_next").isNull(), F.col("_prev.v")
    ).otherwise(F.col("_prev.v") + slope * (F.col("_at") - F.col("_prev._at")))
    return pos.select(*[value.alias(c) if c == column else F.col(c) for c in df.columns])


def replace_missing(df: DataFrame, process: str, order_by: Sequence[str] | None = None,
                    series: Sequence[str] = (), custom=None, method: str = "exact") -> DataFrame:
    """Every column by one method; columns with no value at all are dropped first.

    All statistics come from one aggregate, not one job per column.
    """
    counts = df.selectExpr(*[f"count(`{c}`) AS `{c}`" for c in df.columns], "count(*) AS _n").first()
    df = df.drop(*[c for c in df.columns if counts[c] == 0])
    gaps = [c for c in df.columns if counts[c] < counts["_n"]]
    numeric = [c for c in gaps if _is(df, c, NumericType)]
    if process == "replace":
        return _fill(df, {
            c: F.lit(NUMERIC_FILL if c in numeric else TEXT_FILL).cast(df.schema[c].dataType)
            for c in gaps if c in numeric or _is(df, c, StringType)
        })
    if process in ("mean", "median") and numeric:
        if process == "mean":
            row = df.selectExpr(*[f"avg(`{c}`) AS `{c}`" for c in numeric]).first()
            values = {c: row[c] for c in numeric}
        else:
            values = {c: q[0] for c, q in column_quantiles(df, numeric, [0.5], method).items()}
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in values.items()})
    if process == "mode" and gaps:
        modes = column_modes(df, gaps)
        return _fill(df, {c: literal(v, df.schema[c].dataType) for c, v in modes.items()})
    if process in ("ffill", "bfill") and gaps:
        return fill_along(df, gaps, process, order_by, series)
    if process == "interpolate":
        return reduce(lambda d, c: interpolate(d, c, order_by, series), numeric, df)
    return df


def fill_all(df: DataFrame, value) -> DataFrame:
    """One value in every missing cell; a column the value does not fit becomes text."""
    cells = {}
    for f in df.schema:
        fits = isinstance(f.dataType, StringType) or (
            isinstance(f.dataType, NumericType) and isinstance(value, (int, float)) and not isinstance(value, bool)
            and (isinstance(f.dataType, FractionalType) or float(value).is_integer())
        )
        c = F.col(f"`{f.name}`")
        cells[f.name] = F.coalesce(c if fits else c.cast("string"), F.lit(value).cast(f.dataType if fits else "string"))
    return df.withColumns(cells)


def predict_from_position(df: DataFrame, column: str, order_by: Sequence[str], trees: int = 20,
                          depth: int = 8, seed: int = 42) -> DataFrame:
    """Random forest of the value on the row's position; fills only missing values."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    pos = ordered.with_position(df, order_by, name="_at")
    vec = VectorAssembler(inputCols=["_at"], outputCol="_x").transform(pos)
    known = vec.where(F.col(column).isNotNull()).select("_x", F.col(column).cast("double").alias("_y"))
    model = RandomForestRegressor(featuresCol="_x", labelCol="_y", predictionCol="_hat", numTrees=trees,
                                  maxDepth=depth, seed=seed).fit(known)
    filled = model.transform(vec)
    return filled.select(*[
        F.coalesce(F.col(column).cast("double"), F.col("_hat")).alias(column) if c == column else F.col(c)
        for c in df.columns
    ])


def category_codes(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """String columns as alphabetical codes (null stays null), with the code tables."""
    from millrace.operators.encode import code_table

    tables = {c: code_table(df, c) for c in columns}
    for c, codes in tables.items():
        side = codes.select(F.col("value").alias("_v"), F.col("code").alias("_c"))
        df = df.join(side, F.col(c) == F.col("_v"), "left").withColumn(c, F.col("_c")).drop("_v", "_c")
    return df, tables


def knn_impute(df: DataFrame, columns: Sequence[str], key: Sequence[str], k: int = 5, donors: int | None = None) -> DataFrame:
    """Mean of the k nearest rows that know the value, by distance over shared columns.

    Distances skip unknown coordinates and scale up by all / shared coordinates; ties go to the smaller key. A gap for which no
    donor shares a column takes the column's mean. Every row that knows a column is a donor for it, or with ``donors`` the so many
    of them with the smallest key hash. Keys must be unique.

    All columns are searched by one nearest-neighbour join (``neighbours.nearest``), in which a row meets only the donors near it.
    """
    strings = [c for c in columns if _is(df, c, StringType)]
    coded, tables = category_codes(df, strings)
    num = coded.withColumns({c: F.col(c).cast("double") for c in columns})
    known = num.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(f"n{j}") for j, c in enumerate(columns)],
                    *[F.avg(c).alias(f"m{j}") for j, c in enumerate(columns)]).first()
    open_ = [j for j in range(len(columns)) if 0 < known[f"n{j}"] < known["_n"]]
    base = num.select(F.struct(*key).alias("_key"), F.array(*columns).alias("_x"))
    pool = [base.select(F.lit(j).alias("_g"), "_key", "_x", F.get("_x", F.lit(j)).alias("_v")).where("_v IS NOT NULL") for j in open_]
    if donors is not None:
        pool = [hash_sample(p.withColumns({f"_k{i}": F.col("_key")[c] for i, c in enumerate(key)}), [f"_k{i}" for i in range(len(key))], donors, 42).select(
            "_g", "_key", "_x", "_v") for p in pool]
    gap = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
    filled = num.where(gap).withColumn("_key", F.struct(*key))
    if open_:
        asked = base.select(F.explode(F.array_compact(F.array(*[F.when(F.get("_x", F.lit(j)).isNull(), F.lit(j)) for j in open_]))).alias("_g"), F.col("_key").alias("_id"), "_x")
        near = nearest(asked, reduce(DataFrame.unionByName, pool), k, len(columns))
        mean = F.aggregate("_best", F.lit(0.0), lambda a, s: a + s["_v"]) / F.size("_best")
        wide = near.groupBy("_id").agg(*[F.max(F.when(F.col("_g") == j, mean)).alias(f"_v{j}") for j in open_])
        filled = filled.join(wide, F.col("_key") == F.col("_id"), "left").drop("_id")
    filled = filled.withColumns({
        c: F.coalesce(c, *([f"_v{j}"] if j in open_ else []), F.lit(known[f"m{j}"])) for j, c in enumerate(columns)}).select(*num.columns)
    filled = filled.unionByName(num.where(~gap))
    for c in strings:
        side = tables[c].select(F.col("value").alias("_v"), F.col("code").alias("_c"))
        filled = filled.join(side, F.round(F.col(c)).cast("bigint") == F.col("_c"), "left").withColumn(c, F.col("_v")).drop("_v", "_c")
    return filled.select(*df.columns)


def apply_suggestions(df: DataFrame, target: str, suggestions: DataFrame, key: Sequence[str],
                      value: str = "value") -> DataFrame:
    """Fill missing values from a table (key..., value as text); text that does not fit stays missing."""
    side = suggestions.groupBy(*key).agg(F.max(value).alias("_s"))
    fit = F.col("_s").try_cast(df.schema[target].dataType)
    return df.join(side, list(key), "left").select(*[
        F.coalesce(F.col(target), fit).alias(target) if c == target else F.col(c) for c in df.columns
    ])


def fill_by_context(df: DataFrame, target: str, context: Sequence[str]) -> DataFrame:
    """Mean (numbers) or smallest mode (others) among rows with equal context, else of all.

    Statistics are grouped first and joined back: a context value that holds a large share of
    the rows costs one aggregate row, and AQE splits its join partition.
    """
    if _is(df, target, NumericType):
        per = df.groupBy(*context).agg(F.avg(target).alias("_near"))
        whole = df.agg(F.avg(target)).first()[0]
        kind = "double"
    else:
        counts = df.where(F.col(target).isNotNull()).groupBy(*context, target).count()
        per = counts.groupBy(*context).agg(F.min(F.struct(-F.col("count"), F.col(target).alias("v")))["v"].alias("_near"))
        whole = column_modes(df, [target])[target]
        kind = df.schema[target].dataType
    rest = F.lit(whole).cast(kind) if isinstance(kind, str) else literal(whole, kind)
    side = per.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(context)], "_near")
    match = [df[c].eqNullSafe(side[f"_c{i}"]) for i, c in enumerate(context)]
    value = F.coalesce(F.col(target).cast(kind), F.col("_near"), rest)
    return df.join(side, match, "left").select(*[value.alias(c) if c == target else F.col(c) for c in df.columns])


def row_context(df: DataFrame, target: str, context: Sequence[str], order_by: Sequence[str],
                reach: int = 2, series: Sequence[str] = ()) -> DataFrame:
    """For rows missing ``target``: their known context and the ``reach`` rows on either side."""
    cells = F.struct(target, *context)

    def neighbours(w: W) -> dict[str, Column]:
        sides = [F.lag(cells, d).over(w) for d in range(reach, 0, -1)] + [F.lead(cells, d).over(w) for d in range(1, reach + 1)]
        return {"neighbours": F.array_compact(F.array(*sides))}

    seen = ordered.framed(df, order_by, neighbours, reach, reach, series)
    return seen.where(F.col(target).isNull()).select(*order_by, *series, *[c for c in context if c not in order_by], "neighbours")


def choose_imputation(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, missing_ratio, method) by rule.

    Nothing missing: none; over 60 % missing: drop; text and dates: mode; numbers: median
    when |skew| > 1, else mean.
    """
    columns = list(columns or df.columns)
    rows = []
    for c in columns:
        share = f"(count(*) - count(`{c}`)) / count(*)"
        best = f"CASE WHEN abs(skewness(`{c}`)) > 1 THEN 'median' ELSE 'mean' END" if _is(df, c, NumericType) else "'mode'"
        rows.append(
            f"named_struct('column', '{c}', 'missing_ratio', {share}, 'method', "
            f"CASE WHEN {share} = 0 THEN 'none' WHEN {share} > 0.6 THEN 'drop' ELSE {best} END)"
        )
    return df.selectExpr(f"array({', '.join(rows)}) AS s").selectExpr("inline(s)")


def drop_missing(df: DataFrame, column: str) -> DataFrame:
    return df.dropna(subset=[column])


def completeness(df: DataFrame) -> DataFrame:
    """One row: the share of cells with a value."""
    filled = " + ".join(f"count(`{c}`)" for c in df.columns)
    return df.selectExpr(f"({filled}) / (count(*) * {len(df.columns)}) AS completeness")
