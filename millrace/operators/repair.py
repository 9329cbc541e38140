"""Repairing anomalies. Statistics come from the rows that are not anomalous.

``labels`` is (key..., label); every function returns the table with the column repaired.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from millrace import ordered
from millrace.operators import missing as M
from millrace.quantiles import column_modes, column_quantiles
from millrace.session import cut_lineage

FLAG = "_anomaly"
Z_THRESHOLDS = (1.5, 2, 3, 4)
CONSTANT = 9999


def flagged(df: DataFrame, labels: DataFrame, key: Sequence[str]) -> DataFrame:
    side = labels.groupBy(*key).agg(F.max("label").alias("_label"))
    joined = df.join(side, list(key), "left")
    return joined.withColumn(FLAG, F.coalesce(F.col("_label") == 1, F.lit(False))).drop("_label")


def _put(marked: DataFrame, column: str, value) -> DataFrame:
    value = value if hasattr(value, "cast") else F.lit(value)
    cell = F.when(F.col(FLAG), value.cast("double")).otherwise(F.col(column).cast("double"))
    return marked.withColumn(column, cell).drop(FLAG)


def _clean(marked: DataFrame, column: str) -> DataFrame:
    return marked.where(~F.col(FLAG) & F.col(column).isNotNull()).select(F.col(column).cast("double").alias(column))


def statistic(df: DataFrame, column: str, name: str, percentile: float = 90, trim: float = 0.05):
    """One number: mean, median, mode, trim_mean, winsorize, gmean, hmean, custom_percentile."""
    if name in ("mean", "gmean", "hmean"):
        sql = {"mean": "avg({c})", "gmean": "exp(avg(ln({c})))", "hmean": "1 / avg(1 / {c})"}[name]
        if name != "mean" and df.agg(F.min(column)).first()[0] <= 0:
            raise ValueError(f"{name} needs positive values")
        return df.selectExpr(sql.format(c=f"`{column}`")).first()[0]
    if name == "mode":
        return column_modes(df, [column])[column]
    if name in ("median", "custom_percentile"):
        return column_quantiles(df, [column], [0.5 if name == "median" else percentile / 100])[column][0]
    n = df.count()
    k = int(trim * n)
    lo, hi = column_quantiles(df, [column], [k / (n - 1), (n - k - 1) / (n - 1)])[column]
    c = F.col(column)
    if name == "winsorize":
        return df.agg(F.avg(F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))).first()[0]
    if name == "trim_mean":
        # Values equal to a border are kept as often as the ranks inside say.
        total, below, above = df.agg(
            F.sum(F.when(c.between(lo, hi), c)), F.count_if(c < lo), F.count_if(c > hi)).first()
        return (total - lo * (k - below) - hi * (k - above)) / (n - 2 * k)
    raise ValueError(f"unknown statistic {name}")


def fix(df: DataFrame, column: str, labels: DataFrame, key: Sequence[str], method: str,
        order_by: Sequence[str] | None = None, features: Sequence[str] = (), **options) -> DataFrame:
    """Repair ``column`` where ``labels`` says 1.

    Methods: mean, median, mode, interpolation (``kind`` linear or nearest), knn, simple
    (``strategy``), moving_average (``window``), winsorize, zscore (``threshold``, ``stat``),
    quantile, random_forest.
    """
    marked = flagged(df, labels, key)
    clean = _clean(marked, column)
    if method in ("zscore", "quantile", "median", "mode", "simple"):
        clean = cut_lineage(clean)  # one narrow column, read several times: the join with the labels is not repeated
    order_by = list(order_by or key)
    if method == "mean":
        return _put(marked, column, F.bround(F.lit(statistic(clean, column, "mean")), 3))
    if method in ("median", "mode"):
        return _put(marked, column, statistic(clean, column, method))
    if method == "simple":
        strategy = options.get("strategy", "mean")
        if strategy == "constant":
            return _put(marked, column, options.get("value", CONSTANT))
        value = statistic(clean, column, {"most_frequent": "mode"}.get(strategy, strategy))
        return _put(marked, column, F.bround(F.lit(value), options["decimals"]) if "decimals" in options else value)
    hidden = marked.withColumn(column, F.when(~F.col(FLAG), F.col(column).cast("double")))
    if method == "knn":
        if not features:  # with no other column every row is as near: the mean of the column
            return _put(marked, column, statistic(clean, column, "mean"))
        return M.knn_impute(hidden, [column, *features], key, options.get("k", 5)).drop(FLAG)
    if method == "interpolation":
        if options.get("kind", "linear") == "linear":
            return M.interpolate(hidden, column, order_by).drop(FLAG)
        return _nearest(hidden, column, order_by).drop(FLAG)
    if method == "moving_average":
        w = options.get("window", 3)
        out = ordered.framed(
            hidden, order_by, lambda o: {"_ma": F.avg(column).over(o.rowsBetween(-(w - 1), 0))}, before=w - 1)
        return out.withColumn(column, F.when(F.col(FLAG), F.col("_ma")).otherwise(F.col(column))).drop("_ma", FLAG)
    if method == "winsorize":
        bad = marked.where(F.col(FLAG) & F.col(column).isNotNull()).select(F.col(column).cast("double").alias(column))
        n = bad.count()
        if n < 2:
            return marked.drop(FLAG)
        low, high = int(options.get("lower", 0.05) * n), int(options.get("upper", 0.05) * n)
        lo, hi = column_quantiles(bad, [column], [low / (n - 1), (n - high - 1) / (n - 1)])[column]
        return _put(marked, column, F.least(F.greatest(F.col(column), F.lit(lo)), F.lit(hi)))
    if method == "zscore":
        mean, std = clean.agg(F.avg(column), F.stddev_pop(column)).first()
        near = clean.where(F.abs((F.col(column) - mean) / (std or 1.0)) < options.get("threshold", 3))
        if near.isEmpty():
            return marked.drop(FLAG)
        return _put(marked, column, statistic(near, column, options.get("stat", "mean"), options.get("percentile", 90)))
    if method == "quantile":
        lo, hi = column_quantiles(clean, [column], [options.get("lower", 0.05), options.get("upper", 0.95)])[column]
        return _put(marked, column, F.least(F.greatest(F.col(column), F.lit(lo)), F.lit(hi)))
    if method == "random_forest":
        return _forest(marked, column, order_by, options.get("lag", 5), options.get("seed", 42))
    raise ValueError(f"unknown method {method}")


def _nearest(hidden: DataFrame, column: str, order_by: Sequence[str]) -> DataFrame:
    """The closer of the previous and the next known value by position; the previous on a tie."""
    small = ordered.is_small(hidden, [])
    pos = ordered.with_position(hidden, order_by, name="_at", small=small)
    pos = pos.withColumn("_k", F.when(F.col(column).isNotNull(), F.struct(F.col("_at"), F.col(column).alias("v"))))
    both = ordered.fill_along(
        pos if small else cut_lineage(pos), ["_k"], ["_at"], forward={"_k": "_p"}, backward={"_k": "_n"}, small=small)
    to_prev, to_next = F.col("_at") - F.col("_p._at"), F.col("_n._at") - F.col("_at")
    value = F.when(F.col("_n").isNull() | (to_prev <= to_next), F.col("_p.v")).otherwise(F.col("_n.v"))
    return both.withColumn(column, F.coalesce(F.col(column), value)).select(*hidden.columns)


def _forest(marked: DataFrame, column: str, order_by: Sequence[str], lag: int, seed: int) -> DataFrame:
    """Random forest on the value ``lag`` rows earlier (its gaps take the mean)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    mean = _clean(marked, column).agg(F.avg(column)).first()[0]
    shifted = ordered.framed(
        marked, order_by, lambda w: {"_shift": F.coalesce(F.lag(F.col(column).cast("double"), lag).over(w), F.lit(mean))}, before=lag)
    vec = VectorAssembler(inputCols=["_shift"], outputCol="_x").transform(shifted)
    train = vec.where(~F.col(FLAG) & F.col(column).isNotNull()).select("_x", F.col(column).cast("double").alias("_y"))
    model = RandomForestRegressor(featuresCol="_x", labelCol="_y", predictionCol="_hat", numTrees=20, seed=seed).fit(train)
    return _put(model.transform(vec), column, F.col("_hat")).drop("_shift", "_x", "_hat")


def change_log(before: DataFrame, after: DataFrame, labels: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    """(key..., column, anomaly_value, fixed_value) of the labelled rows, sorted by key."""
    rows = labels.where("label = 1").select(*key).distinct()
    old = before.select(*key, F.col(column).cast("double").alias("anomaly_value"))
    new = after.select(*key, F.col(column).cast("double").alias("fixed_value"))
    return rows.join(old, list(key)).join(new, list(key)).select(
        *key, F.lit(column).alias("column"), "anomaly_value", "fixed_value").orderBy(*key)


def review_table(log: DataFrame, edits: DataFrame, key: Sequence[str]) -> DataFrame:
    """The change log with the human value (the machine's when there is none)."""
    side = edits.select(*key, "column", F.col("value").alias("_v"))
    return log.join(side, [*key, "column"], "left").withColumn(
        "final_value", F.coalesce(F.col("_v").try_cast("double"), F.col("fixed_value"))).drop("_v")
