"""Encoders, binning, feature generation and selection."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame, functions as F

from millrace.ordered import with_position
from millrace.operators.profile import correlation, correlations

LEVEL_LIMIT = 10_000


def code_table(df: DataFrame, column: str) -> DataFrame:
    """(value, code): alphabetical codes from 0, numbered without a single-task sort."""
    values = df.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct()
    return with_position(values, ["value"], name="code")


def _join_by_value(df: DataFrame, column: str, table: DataFrame, value: str, added: str) -> DataFrame:
    side = table.select(F.col("value").alias("_v"), F.col(value).alias(added))
    return df.join(side, F.col(column) == F.col("_v"), "left").drop("_v")


def label_encode(df: DataFrame, column: str, output: str | None = None, codes: DataFrame | None = None) -> DataFrame:
    """Alphabetical code; null or unknown -> -1."""
    output = output or f"{column}_code"
    out = _join_by_value(df, column, codes if codes is not None else code_table(df, column), "code", output)
    return out.withColumn(output, F.coalesce(output, F.lit(-1)).cast("bigint"))


def levels(df: DataFrame, column: str, limit: int = LEVEL_LIMIT) -> list:
    """The distinct values, sorted; more than ``limit`` is an error: columns are metadata."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} values: use another encoding")
    return sorted(r[0] for r in rows)


def one_hot(df: DataFrame, column: str, known: Sequence | None = None, drop_first: bool = False) -> DataFrame:
    """A 0/1 column per level; unknown values are all zero."""
    known = list(known if known is not None else levels(df, column))[1 if drop_first else 0:]
    return df.withColumns({
        f"{column}_{v}": F.coalesce((F.col(column) == F.lit(v)).cast("int"), F.lit(0)) for v in known
    }).drop(column)


def one_hot_vector(df: DataFrame, columns: Sequence[str]):
    """The vector form for ML stages, unknown values all zero: (table, fitted pipeline model)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer

    index = StringIndexer(inputCols=list(columns), outputCols=[f"{c}_index" for c in columns],
                          handleInvalid="keep", stringOrderType="alphabetAsc")
    hot = OneHotEncoder(inputCols=[f"{c}_index" for c in columns], outputCols=[f"{c}_vec" for c in columns],
                        handleInvalid="keep", dropLast=True)
    model = Pipeline(stages=[index, hot]).fit(df)
    return model.transform(df), model


def target_encode(df: DataFrame, column: str, target: str, smoothing: float = 10.0, output: str | None = None) -> DataFrame:
    """Mean of the target per value, pulled to the global mean; unknown -> global mean."""
    output = output or f"{column}_target"
    whole = df.agg(F.avg(target)).first()[0]
    per = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        ((F.sum(target) + F.lit(smoothing * whole)) / (F.count(target) + smoothing)).alias("mean"))
    out = _join_by_value(df, column, per, "mean", output)
    return out.withColumn(output, F.coalesce(output, F.lit(whole)))


def frequency_encode(df: DataFrame, column: str, share: bool = False, output: str | None = None) -> DataFrame:
    output = output or f"{column}_freq"
    per = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    out = _join_by_value(df, column, per, "n", output)
    n = F.coalesce(F.col(output), F.lit(0))
    return out.withColumn(output, n / df.count() if share else n)


def binary_encode(df: DataFrame, column: str) -> DataFrame:
    """The alphabetical code (from 1; null 0) as one column per bit, high bit first."""
    codes = code_table(df, column)
    bits = max(1, int(codes.count()).bit_length())
    out = _join_by_value(df, column, codes, "code", "_code")
    code = F.coalesce(F.col("_code") + 1, F.lit(0)).cast("bigint")
    return out.withColumns({
        f"{column}_bit{b}": F.shiftright(code, b).bitwiseAND(1).cast("int") for b in range(bits - 1, -1, -1)
    }).drop("_code")


def polynomial_features(df: DataFrame, columns: Sequence[str], degree: int = 2) -> DataFrame:
    """Products of up to ``degree`` columns, with powers (``a_x_a``)."""
    return df.withColumns({
        "_x_".join(combo): _product(combo)
        for d in range(2, degree + 1) for combo in combinations_with_replacement(columns, d)
    })


def interaction_terms(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Products of different columns, two at a time."""
    return df.withColumns({"_x_".join(pair): _product(pair) for pair in combinations(columns, 2)})


def _product(columns: Sequence[str]) -> Column:
    out = F.col(columns[0])
    for c in columns[1:]:
        out = out * F.col(c)
    return out


def bin_equal_width(df: DataFrame, column: str, bins: int = 5, output: str | None = None) -> DataFrame:
    """Right-closed bins of equal width, numbered from 0; the first edge is 0.1 % wider."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    if lo is None:
        return df.withColumn(output or f"{column}_bin", F.lit(None).cast("int"))
    edges = [lo + (hi - lo) * i / bins for i in range(bins + 1)]
    edges[0] -= (hi - lo) * 0.001
    c = F.col(column)
    value = F.when(c <= F.lit(edges[1]), 0)
    for i in range(1, bins):
        value = value.when((c <= F.lit(edges[i + 1])) if i < bins - 1 else c.isNotNull(), i)
    return df.withColumn(output or f"{column}_bin", value)


def bin_quantile(df: DataFrame, column: str, bins: int = 4, output: str | None = None) -> DataFrame:
    """Right-closed bins of about equal counts, edges at exact quantiles."""
    from millrace.quantiles import column_quantiles

    edges = column_quantiles(df, [column], [i / bins for i in range(1, bins)])[column]
    value = F.lit(0)
    for e in sorted(set(edges)):
        value = value + F.when(F.col(column) > F.lit(e), 1).otherwise(0)
    return df.withColumn(output or f"{column}_bin", F.when(F.col(column).isNotNull(), value))


def variances(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, score): population variance, one pass."""
    return _stack(df, {c: f"var_pop(`{c}`)" for c in columns})


def _stack(df: DataFrame, scores: dict[str, str]) -> DataFrame:
    rows = ", ".join(f"named_struct('feature', '{c}', 'score', {e})" for c, e in scores.items())
    return df.selectExpr(f"array({rows}) AS s").selectExpr("inline(s)")


def f_regression(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """(feature, score): F of a one-variable linear regression, one pass."""
    r2 = {c: f"power({correlation(f'`{c}`', f'`{target}`')}, 2)" for c in columns}
    return _stack(df, {c: f"try_divide({r} * (count(*) - 2), 1 - {r})" for c, r in r2.items()})


def f_classif(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """(feature, score): one-way analysis of variance, from one row per class."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"), *[
        x for i, c in enumerate(columns) for x in (F.avg(c).alias(f"_m{i}"), F.var_pop(c).alias(f"_v{i}"))
    ])
    scores = {}
    for i, c in enumerate(columns):
        between = f"(sum(_n * _m{i} * _m{i}) - power(sum(_n * _m{i}), 2) / sum(_n))"
        within = f"sum(_n * _v{i})"
        scores[c] = f"try_divide({between} * (sum(_n) - count(*)), {within} * (count(*) - 1))"
    return _stack(per, scores)


def select_k_best(df: DataFrame, columns: Sequence[str], k: int | str = "all", target: str | None = None,
                  task: str = "regression") -> tuple[DataFrame, DataFrame]:
    """The k best features by F score, or by variance without a target: (table, scores)."""
    scores = (variances(df, columns) if target is None else
              f_regression(df, columns, target) if task == "regression" else f_classif(df, columns, target))
    if k == "all":
        return df, scores
    best = {r["feature"] for r in scores.orderBy(F.desc_nulls_last("score"), "feature").limit(k).collect()}
    return df.drop(*[c for c in columns if c not in best]), scores


def drop_low_variance(df: DataFrame, columns: Sequence[str], threshold: float = 0.0) -> DataFrame:
    low = {r["feature"] for r in variances(df, columns).where((F.col("score") <= threshold) | F.col("score").isNull()).collect()}
    return df.drop(*low)


def drop_correlated(df: DataFrame, columns: Sequence[str], threshold: float = 0.9) -> DataFrame:
    """Of each strongly correlated pair the later column goes."""
    pairs = correlations(df, columns).where(F.abs("r") > threshold).collect()  # columns squared rows
    place = {c: i for i, c in enumerate(columns)}
    gone: set[str] = set()
    for a, b in sorted(((r["a"], r["b"]) for r in pairs), key=lambda p: (place[p[0]], place[p[1]])):
        if a not in gone:
            gone.add(b)
    return df.drop(*gone)
