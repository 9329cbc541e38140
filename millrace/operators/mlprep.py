"""Analyses and preparation for machine learning."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from millrace.operators import encode as E
from millrace.operators import scale as Z
from millrace.operators.profile import (
    adjusted_skew, correlations, distinct_counts, numeric_columns, string_columns,
)
from millrace.quantiles import column_quantiles

# Which scaling methods a finding recommends.
RECOMMENDED = {
    "normal": ("standard_scaler", "mean_normalisation"), "outliers": ("robust_scaler", "quantile_normal"),
    "positive": ("log_transform", "box_cox", "minmax_scaler"),
    "negative": ("yeo_johnson", "standard_scaler", "robust_scaler"), "sparse": ("maxabs_scaler",), "wide": ("pca",),
}


def data_characteristics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, outliers, skew, shape, has_negative, has_zero, sparse): two passes for all columns."""
    q = column_quantiles(df, columns, [0.25, 0.75])
    rows = []
    for c in columns:
        q1, q3 = q[c]
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        k, skew = f"`{c}`", adjusted_skew(f"`{c}`")
        rows.append(
            f"named_struct('column', '{c}', 'outliers', count_if({k} < double({lo!r}) OR {k} > double({hi!r})) > 0.05 * count({k}), "
            f"'skew', {skew}, 'shape', CASE WHEN abs({skew}) < 0.5 THEN 'normal' WHEN abs({skew}) > 1 THEN 'skewed' ELSE 'neither' END, "
            f"'has_negative', count_if({k} < 0) > 0, 'has_zero', count_if({k} = 0) > 0, "
            f"'sparse', count_if({k} = 0) > 0.9 * count({k}))"
        )
    return df.selectExpr(f"array({', '.join(rows)}) AS s").selectExpr("inline(s)")


def recommend_scaling(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(method): the recommended methods for a set of columns."""
    found = data_characteristics(df, columns).agg(
        F.max((F.col("shape") == "normal")).alias("normal"), F.max("outliers").alias("outliers"),
        F.max("has_negative").alias("negative"), F.max("sparse").alias("sparse")).first()
    kinds = [k for k in ("normal", "outliers", "sparse") if found[k]] + (["negative"] if found["negative"] else ["positive"])
    kinds += ["wide"] if len(columns) > 10 else []
    methods = sorted({m for k in kinds for m in RECOMMENDED[k]})
    return df.sparkSession.createDataFrame([(m,) for m in methods], "method string")


def ml_issues(df: DataFrame, target: str | None = None) -> DataFrame:
    """(kind, subject, amount): what stands in the way of training."""
    columns = [c for c in df.columns if c != target]
    texts, numbers = (set(f(df)) & set(columns) for f in (string_columns, numeric_columns))
    distinct = distinct_counts(df, columns)
    is_text = F.col("column").isin(*texts) if texts else F.lit(False)
    is_number = F.col("column").isin(*numbers) if numbers else F.lit(False)
    kinds = distinct.select(
        F.when(is_text & (F.col("distinct") > 50), "high_cardinality").when(is_text & (F.col("distinct") == 2), "binary")
        .when(is_text, "one_hot").when(is_number & (F.col("distinct") == 1), "constant").alias("kind"),
        F.col("column").alias("subject"), F.col("distinct").cast("double").alias("amount"),
    ).where("kind IS NOT NULL")
    rows = ", ".join(f"named_struct('subject', '{c}', 'amount', (count(*) - count(`{c}`)) * 100D / count(*))" for c in columns)
    gaps = df.selectExpr(f"array({rows}) AS s").selectExpr("inline(s)").where("amount > 0").select(
        F.when(F.col("amount") > 30, "high_missing").otherwise("missing").alias("kind"), "subject", "amount")
    out = kinds.unionByName(gaps)
    pairs = [c for c in df.columns if c in numbers]
    if len(pairs) > 1:
        out = out.unionByName(correlations(df, pairs).where(F.abs("r") > 0.9).select(
            F.lit("correlated").alias("kind"), F.concat_ws(" ~ ", "a", "b").alias("subject"), F.abs("r").alias("amount")))
    return out


def selection_advice(df: DataFrame, target: str | None = None) -> DataFrame:
    """One row: whether to select features, how sure, and how many to keep."""
    n, width = df.count(), len(df.columns)
    ratio = n / width if width else float("inf")
    columns = [c for c in df.columns if c != target]
    constant = distinct_counts(df, columns).where("distinct <= 1").count()
    numbers = [c for c in numeric_columns(df) if c != target]
    strong = correlations(df, numbers).where(F.abs("r") > 0.95).count() if len(numbers) > 1 else 0
    wanted = ratio < 10 or constant > 0 or strong > 5 or width > 100
    confidence = "medium" if width > 100 or 3 <= ratio < 10 else "high" if ratio < 3 else "low"
    k = None
    if wanted:
        k = (min(20, max(5, n // 3)) if ratio < 3 else min(30, max(10, n // 2)) if ratio < 10
             else min(40, width // 2) if width > 50 else min(30, width - 2))
    return df.sparkSession.createDataFrame(
        [(wanted, confidence, k, float(ratio), constant, strong)],
        "recommended boolean, confidence string, suggested_k bigint, ratio double, constant_features bigint, correlated_pairs bigint")


def prepare_for_ml(df: DataFrame, numeric_method: str = "standard_scaler", categorical_method: str = "onehot",
                   target: str | None = None) -> tuple[DataFrame, dict]:
    """Numbers: median fill, then scaling; text: 'missing' for gaps, then encoding."""
    numbers = [c for c in numeric_columns(df) if c != target]
    texts = [c for c in string_columns(df) if c != target]
    medians = {c: q[0] for c, q in column_quantiles(df, numbers, [0.5]).items()} if numbers else {}
    out = df.withColumns({
        **{c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in medians.items()},
        **{c: F.coalesce(F.col(c), F.lit("missing")) for c in texts},
    })
    params = Z.fit(out, numbers, numeric_method) if numbers else {}
    out = Z.apply(out, params)
    for c in texts:
        if categorical_method == "onehot":
            out = E.one_hot(out, c)
        elif categorical_method in ("label", "ordinal"):
            out = E.label_encode(out, c).drop(c).withColumnRenamed(f"{c}_code", c)
        elif categorical_method == "target":
            out = E.target_encode(out, c, target).drop(c).withColumnRenamed(f"{c}_target", c)
        else:
            raise ValueError(f"unknown encoding {categorical_method}")
    return out, {"medians": medians, "scaling": params}


def split_rows(df: DataFrame, key: Sequence[str], train_pct: int = 80, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the key: the same rows whatever the partitioning."""
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))
    slot = F.conv(F.substring(digest, 1, 6), 16, 10).cast("bigint") % 100
    return df.where(slot < train_pct), df.where(slot >= train_pct)


def fit_linear(df: DataFrame, target: str, features: Sequence[str], key: Sequence[str]) -> DataFrame:
    """One row: test MSE, intercept and coefficients of a linear regression on an 80/20 split.

    One aggregate takes the cross products of both parts, from which the coefficients and the test error follow.
    """
    names = ["1D", *[f"CAST(`{c}` AS DOUBLE)" for c in [*features, target]]]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    train, test = split_rows(df.dropna(subset=[target, *features]), key)

    def products(part: DataFrame, test_part: bool) -> DataFrame:
        return part.select(F.lit(test_part).alias("_t"), *[F.expr(n).alias(f"_v{i}") for i, n in enumerate(names)])

    sums = products(train, False).unionAll(products(test, True)).groupBy("_t").agg(
        *[F.sum(F.col(f"_v{i}") * F.col(f"_v{j}")).alias(f"s{i}_{j}") for i, j in pairs]).collect()
    gram = {}
    for row in sums:
        g = gram[row["_t"]] = np.zeros((len(names), len(names)))
        for i, j in pairs:
            g[i, j] = g[j, i] = row[f"s{i}_{j}"]
    g, k = gram[False], len(names) - 1
    beta = np.linalg.pinv(g[:k, :k]) @ g[:k, k]
    away = np.append(-beta, 1.0)
    mse = float(away @ gram[True] @ away / gram[True][0, 0]) if True in gram else None
    return df.sparkSession.createDataFrame(
        [(mse, *[float(x) for x in beta])], "mse double, intercept double, " + ", ".join(f"`coef_{c}` double" for c in features))
