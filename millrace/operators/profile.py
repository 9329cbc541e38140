"""Column and table profiles, correlations, distinct values, chart aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (
    DateType, NumericType, StringType, TimestampNTZType, TimestampType,
)

from millrace.quantiles import clean_double, column_quantiles, group_quantiles

QUARTILES = {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95}
TEXT_LENGTH = 20


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, StringType)]


def adjusted_skew(c: str) -> str:
    """Sample skewness from Spark's population skewness, as SQL text."""
    return f"(skewness({c}) * sqrt(count({c}) * (count({c}) - 1D)) / nullif(count({c}) - 2D, 0))"


def adjusted_kurtosis(c: str) -> str:
    """Sample excess kurtosis from Spark's population kurtosis, as SQL text."""
    n = f"count({c})"
    return f"(({n} - 1D) / nullif(({n} - 2D) * ({n} - 3D), 0) * (({n} + 1D) * kurtosis({c}) + 6))"


def correlation(a: str, b: str) -> str:
    """Pearson correlation as SQL text; NULL (not an error) when a column is constant."""
    return f"try_divide(regr_sxy({a}, {b}), sqrt(regr_sxx({a}, {b}) * regr_syy({a}, {b})))"


def distinct_counts(df: DataFrame, columns: Sequence[str], method: str = "exact") -> DataFrame:
    """One row per column: (column, distinct).

    Values go long form and equal ones combine map-side, so each column's distinct values
    are shuffled once and no row is copied per column inside one wide aggregate.
    """
    if method == "approx":
        cells = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns])
        return cells.unpivot([], list(columns), "column", "distinct")
    pairs = ", ".join(
        f"named_struct('c', '{c}', 'v', CAST(`{c}` AS string))" for c in columns
    )
    long = df.selectExpr(f"inline(array({pairs}))").where("v IS NOT NULL")
    seen = long.groupBy("c", "v").agg(F.lit(1).alias("one"))
    counted = seen.groupBy("c").agg(F.sum("one").alias("distinct"))
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return every.join(F.broadcast(counted), every["column"] == counted["c"], "left").select(
        "column", F.coalesce("distinct", F.lit(0)).cast("bigint").alias("distinct")
    )


def profile_numeric(
    df: DataFrame, columns: Sequence[str] | None = None, method: str = "exact"
) -> DataFrame:
    """One row per numeric column: counts, range, quantiles, moments."""
    columns = list(columns or numeric_columns(df))
    quantiles = column_quantiles(df, columns, list(QUARTILES.values()), method)
    fitted = df.sparkSession.createDataFrame(
        [(c, *quantiles[c]) for c in columns], "column string, " + ", ".join(f"{q} double" for q in QUARTILES))
    # Long form: one small set of aggregates for all columns keeps the generated code small.
    cells = ", ".join(f"named_struct('column', '{c}', 'v', `{c}`)" for c in columns)
    long = df.select(*[clean_double(c).alias(c) for c in columns]).selectExpr(f"inline(array({cells}))")
    stats = long.groupBy("column").agg(
        F.count(F.lit(1)).alias("count"), (F.count(F.lit(1)) - F.count("v")).alias("missing"),
        F.count_if(F.col("v") == 0).alias("zeroes"), F.max("v").alias("max"), F.min("v").alias("min"),
        (F.max("v") - F.min("v")).alias("rng"), F.avg("v").alias("avg"), F.stddev_samp("v").alias("std"),
        F.var_samp("v").alias("var"), F.expr(adjusted_kurtosis("v")).alias("kurt"), F.expr(adjusted_skew("v")).alias("skew"),
        F.sum("v").alias("sum"),
    )
    if method == "approx":
        distinct = long.groupBy("column").agg(F.approx_count_distinct("v").alias("distinct"))
    else:
        seen = long.where("v IS NOT NULL").groupBy("column", "v").agg(F.lit(1).alias("one"))
        distinct = seen.groupBy("column").agg(F.sum("one").cast("bigint").alias("distinct"))
    # One row per column on every side.
    out = stats.join(F.broadcast(fitted), "column").join(F.broadcast(distinct), "column", "left")
    return out.withColumns({
        "iqr": F.col("q75") - F.col("q25"), "distinct": F.coalesce("distinct", F.lit(0).cast("bigint")),
        "duplicates": F.col("count") - F.coalesce("distinct", F.lit(0).cast("bigint")),
    })


def as_timestamp(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    if isinstance(kind, (TimestampType, TimestampNTZType, DateType)):
        return F.col(column).cast("timestamp_ntz")
    return F.expr(f"try_cast(`{column}` AS timestamp_ntz)")


def is_date_column(df: DataFrame, column: str, share: float = 0.5) -> bool:
    """A date type, or a string column of which more than ``share`` of all rows parse."""
    if isinstance(df.schema[column].dataType, (TimestampType, TimestampNTZType, DateType)):
        return True
    if not isinstance(df.schema[column].dataType, StringType):
        return False
    row = df.agg(F.count(as_timestamp(df, column)).alias("ok"), F.count(F.lit(1)).alias("n")).first()
    return row["ok"] > share * row["n"]


def _micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a timestamp without time zone."""
    day = F.datediff(ts, F.lit("1970-01-01").cast("date")).cast("bigint")
    of_day = F.hour(ts) * 3600 + F.minute(ts) * 60
    micros = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    return (day * 86400 + of_day) * 1_000_000 + micros


def profile_dates(df: DataFrame, column: str, method: str = "exact") -> DataFrame:
    """One row for a date or date-like column.

    Moments are of the hour (with minutes as a fraction) when any value has a time of day,
    else of the year; the IQR is in hours or whole days accordingly.
    """
    ts = df.select(as_timestamp(df, column).alias("t"))
    has_time = ts.agg(F.max((F.hour("t") != 0) | (F.minute("t") != 0)).alias("x")).first()["x"]
    q = column_quantiles(ts.select(_micros(F.col("t")).alias("u")), ["u"], list(QUARTILES.values()), method)["u"]
    pattern = "yyyy-MM-dd HH:mm:ss" if has_time else "yyyy-MM-dd"
    part = F.hour("t") + F.minute("t") / 60 if has_time else F.year("t").cast("double")
    ts = ts.withColumn("p", part)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")

    def moment(u: float | None) -> Column:
        at = epoch + F.make_dt_interval(secs=F.lit(0 if u is None else u / 1e6).cast("decimal(18,6)"))
        return F.date_format(at, pattern) if u is not None else F.lit(None).cast("string")

    iqr = None if q[0] is None else (q[3] - q[1]) / 3.6e9 if has_time else float((q[3] - q[1]) // 86_400_000_000)
    return ts.agg(
        F.count(F.lit(1)).alias("count"), (F.count(F.lit(1)) - F.count("t")).alias("missing"),
        F.count_distinct("t").alias("distinct"),
        (F.count(F.lit(1)) - F.count_distinct("t")).alias("duplicates"),
        F.date_format(F.max("t"), pattern).alias("max"), F.date_format(F.min("t"), pattern).alias("min"),
        F.floor((F.max(_micros(F.col("t"))) - F.min(_micros(F.col("t")))) / 86_400_000_000).alias("rng"),
        F.avg("p").alias("avg"), F.stddev_samp("p").alias("std"), F.var_samp("p").alias("var"),
        F.expr(adjusted_kurtosis("p")).alias("kurt"), F.expr(adjusted_skew("p")).alias("skew"),
    ).withColumns({
        "column": F.lit(column), "iqr": F.lit(iqr).cast("double"),
        **{n: moment(u) for n, u in zip(QUARTILES, q)},
    })


def table_summary(df: DataFrame) -> DataFrame:
    """Rows, duplicate rows and the number of columns by class."""
    texts = string_columns(df)
    longest = df.agg(*[F.max(F.length(c)).alias(c) for c in texts]).first() if texts else []
    text = sum(1 for n in longest if (n or 0) > TEXT_LENGTH)
    dup = df.groupBy(*df.columns).count().agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"),
    )
    return dup.withColumns({
        "features": F.lit(len(df.columns)), "numerical": F.lit(len(numeric_columns(df))),
        "categorical": F.lit(len(texts) - text), "text": F.lit(text),
    })


def describe(df: DataFrame, columns: Sequence[str] | None = None, method: str = "exact") -> DataFrame:
    """count, mean, std, min, quartiles, max per numeric column, quantiles exact."""
    columns = list(columns or numeric_columns(df))
    q = column_quantiles(df, columns, [0.25, 0.5, 0.75], method)
    rows = ", ".join(
        f"named_struct('column', '{c}', 'count', count(`{c}`), 'mean', avg(`{c}`), 'std', stddev_samp(`{c}`), "
        f"'min', double(min(`{c}`)), 'p25', double({q[c][0]!r}), 'p50', double({q[c][1]!r}), "
        f"'p75', double({q[c][2]!r}), 'max', double(max(`{c}`)))".replace("double(None)", "CAST(NULL AS double)")
        for c in columns
    )
    return df.selectExpr(f"array({rows}) AS s").selectExpr("inline(s)")


def missing_share(df: DataFrame) -> DataFrame:
    """(column, missing, missing_pct) for every column, one pass."""
    rows = ", ".join(
        f"named_struct('column', '{c}', 'missing', count(*) - count(`{c}`), "
        f"'missing_pct', (count(*) - count(`{c}`)) * 100D / count(*))" for c in df.columns
    )
    return df.selectExpr(f"array({rows}) AS s").selectExpr("inline(s)")


def column_info(df: DataFrame, method: str = "exact") -> DataFrame:
    """(column, dtype, missing, distinct) for every column."""
    kinds = df.sparkSession.createDataFrame(df.dtypes, "column string, dtype string")
    info = missing_share(df).select("column", "missing").join(F.broadcast(kinds), "column")
    return info.join(F.broadcast(distinct_counts(df, df.columns, method)), "column")


def dtype_groups(df: DataFrame) -> DataFrame:
    """(dtype, columns, n): metadata only."""
    groups: dict[str, list[str]] = {}
    for c, kind in df.dtypes:
        groups.setdefault(kind, []).append(c)
    return df.sparkSession.createDataFrame(
        [(k, ",".join(v), len(v)) for k, v in sorted(groups.items())], "dtype string, columns string, n bigint"
    )


def distinct_value_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n): every distinct value as a row, with its number of rows; one job for all columns."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(cells.alias("x")).where("x.value IS NOT NULL").groupBy("x.column", "x.value").agg(F.count(F.lit(1)).alias("n"))


def distinct_values(df: DataFrame, columns: Sequence[str], show: int | None = None) -> DataFrame:
    """(column, n_values, values): the exact number, and all values joined (with ``show``, that many of the smallest).

    Joining puts a column's values into one cell; ``distinct_value_rows`` has them as rows.
    """
    out = None
    for c in columns:
        values = df.select(F.col(c).cast("string").alias("v")).where("v IS NOT NULL").distinct()
        shown = (values.orderBy("v").limit(show) if show else values).agg(
            F.concat_ws(", ", F.array_sort(F.collect_list("v"))).alias("values")
        )
        one = values.agg(F.count(F.lit(1)).alias("n_values")).join(shown).select(
            F.lit(c).alias("column"), "n_values", "values"
        )
        out = one if out is None else out.unionByName(one)
    return out


def dataset_summary(df: DataFrame) -> DataFrame:
    """One row: shape, column classes, missing cells and share, duplicate rows."""
    cells = " + ".join(f"(count(*) - count(`{c}`))" for c in df.columns)
    kinds = [f.dataType for f in df.schema]
    dates = sum(isinstance(k, (TimestampType, TimestampNTZType, DateType)) for k in kinds)
    dup = df.groupBy(*df.columns).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))
    return df.selectExpr(
        "count(*) AS rows", f"{len(kinds)} AS columns", f"{len(numeric_columns(df))} AS numeric_columns",
        f"{len(string_columns(df))} AS categorical_columns", f"{dates} AS datetime_columns",
        f"{cells} AS missing", f"({cells}) * 100D / (count(*) * {len(kinds)}) AS missing_pct",
    ).join(dup)


def top_values(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    """The k most frequent values; ties go to the smaller value."""
    counts = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.where("value IS NOT NULL").orderBy(F.desc("n"), "value").limit(k)


def analyze_column(df: DataFrame, column: str) -> DataFrame:
    """One row: distinct, missing, share, and min/max/mean/median/std of a numeric column."""
    median = column_quantiles(df, [column], [0.5])[column][0]
    return df.agg(
        F.count_distinct(column).alias("unique"), F.count_if(F.col(column).isNull()).alias("missing"),
        (F.count_if(F.col(column).isNull()) * 100 / F.count(F.lit(1))).alias("missing_pct"),
        F.min(column).alias("min"), F.max(column).alias("max"), F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
    ).withColumns({"median": F.lit(median).cast("double"), "column": F.lit(column)})


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(a, b, r) for every pair, nulls skipped pair by pair, all in one aggregate."""
    columns = list(columns or numeric_columns(df))
    pairs = ", ".join(
        f"named_struct('a', '{a}', 'b', '{b}', 'r', {correlation(f'`{a}`', f'`{b}`')})" for a, b in combinations(columns, 2)
    )
    return df.selectExpr(f"array({pairs}) AS s").selectExpr("inline(s)")


def high_correlations(df: DataFrame, threshold: float, columns: Sequence[str] | None = None) -> DataFrame:
    return correlations(df, columns).where(F.abs("r") > threshold)


def insights(df: DataFrame, pairs: int = 3) -> DataFrame:
    """(kind, subject, amount): strong correlations, mostly missing columns, binary columns."""
    strong = high_correlations(df, 0.7).orderBy(F.abs("r").desc(), "a", "b").limit(pairs).selectExpr(
        "'correlation' AS kind", "concat(a, ' ~ ', b) AS subject", "r AS amount")
    sparse = missing_share(df).where("missing_pct > 30").selectExpr(
        "'missing' AS kind", "`column` AS subject", "missing_pct AS amount")
    binary = distinct_counts(df, df.columns).where("distinct = 2").selectExpr(
        "'binary' AS kind", "`column` AS subject", "double(distinct) AS amount")
    return strong.unionByName(sparse).unionByName(binary)


# The questions a caller may ask, each a one-row metric.
ANSWERS = {
    "missing": lambda df: df.selectExpr(
        " + ".join(f"(count(*) - count(`{c}`))" for c in df.columns) + " AS answer"),
    "duplicates": lambda df: df.groupBy(*df.columns).count().agg(
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("answer")),
    "columns": lambda df: df.limit(0).agg((F.count(F.lit(1)) + len(df.columns)).alias("answer")),
    "rows": lambda df: df.agg(F.count(F.lit(1)).alias("answer")),
}


def answer(df: DataFrame, metric: str) -> DataFrame:
    return ANSWERS[metric](df)


def crosstab_top(df: DataFrame, a: str, b: str, k: int = 5, limit: int = 20) -> DataFrame:
    """The k most frequent value pairs, when both columns have fewer than ``limit`` values."""
    sizes = {r["column"]: r["distinct"] for r in distinct_counts(df, [a, b]).collect()}
    pairs = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    if max(sizes.values()) >= limit:
        return pairs.limit(0)
    return pairs.orderBy(F.desc("n"), a, b).limit(k)


def group_sum(df: DataFrame, by: str, value: str) -> DataFrame:
    return df.groupBy(by).agg(F.sum(value).alias("total")).orderBy("total")


def context_analysis(df: DataFrame, target: str, context: Sequence[str]) -> DataFrame:
    """(context, r, strength) of a numeric target with each numeric context column."""
    pairs = ", ".join(f"named_struct('context', '{c}', 'r', {correlation(f'`{target}`', f'`{c}`')})" for c in context)
    size = F.abs("r")
    return df.selectExpr(f"array({pairs}) AS s").selectExpr("inline(s)").withColumn(
        "strength", F.when(size > 0.7, "strong").when(size > 0.3, "moderate").otherwise("weak"))


def path_sums(df: DataFrame, path: Sequence[str], value: str) -> DataFrame:
    """Sums along a path of columns (pie, sunburst, treemap): one row per prefix."""
    return df.rollup(*path).agg(F.sum(value).alias("total"), F.grouping_id().alias("level"))


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin, low, high, n) over equal bins from min to max, last edge included."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    if lo is None:
        return df.limit(0).selectExpr("0 AS bin", "0D AS low", "0D AS high", "0L AS n")
    width = (hi - lo) / bins or 1.0
    bin_ = F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1)).cast("int")
    return df.where(F.col(column).isNotNull()).groupBy(bin_.alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    ).select("bin", (F.lit(lo) + F.col("bin") * width).alias("low"),
             (F.lit(lo) + (F.col("bin") + 1) * width).alias("high"), "n")


def heatmap(df: DataFrame, a: str, b: str, bins: int = 10) -> DataFrame:
    """(a_bin, b_bin, n) of two columns."""
    lo_a, hi_a, lo_b, hi_b = df.agg(F.min(a), F.max(a), F.min(b), F.max(b)).first()

    def bin_(c: str, lo: float, hi: float) -> Column:
        return F.least(F.floor((F.col(c) - lo) / ((hi - lo) / bins or 1.0)), F.lit(bins - 1)).cast("int")

    return df.groupBy(bin_(a, lo_a, hi_a).alias("a_bin"), bin_(b, lo_b, hi_b).alias("b_bin")).agg(
        F.count(F.lit(1)).alias("n"))


def null_mask_counts(df: DataFrame) -> DataFrame:
    """(variable, missing, n): how many cells are and are not null, per column, one pass."""
    rows = ", ".join(
        f"named_struct('variable', '{c}', 'missing', true, 'n', count(*) - count(`{c}`)), "
        f"named_struct('variable', '{c}', 'missing', false, 'n', count(`{c}`))" for c in df.columns
    )
    return df.selectExpr(f"array({rows}) AS s").selectExpr("inline(s)").where("n > 0")


def numeric_like(df: DataFrame) -> DataFrame:
    """(column, parsed): columns with at least one value that is a number."""
    rows = ", ".join(
        f"named_struct('column', '{c}', 'parsed', count(try_cast(CAST(`{c}` AS string) AS double)))"
        for c, k in df.dtypes if k != "boolean"
    )
    return df.selectExpr(f"array({rows}) AS s").selectExpr("inline(s)").where("parsed > 0")


def box_stats(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, min, q25, q50, q75, max, n) per group, quantiles exact and skew-safe."""
    q = group_quantiles(df, [by], value, [0.25, 0.5, 0.75], ["q25", "q50", "q75"])
    ends = df.groupBy(by).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n"))
    return q.join(ends, by)
