"""Anomaly detection over columns and models, and summaries of the labels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import NumericType

from millrace.operators import multivariate as MV
from millrace.operators.detectors import EXACT
from millrace.operators.sampled import SAMPLED, score_sampled
from millrace.quantiles import column_modes, column_quantiles
from millrace.session import cut_lineage

CONTAMINATION = 0.1
MAD_THRESHOLD = 3.5
SUOD_BASE = ("KNN", "HBOS", "ECOD", "COPOD")
#: Models over all columns together, with the least number of columns for which they are.
WHOLE_TABLE = {"FB": (MV.feature_bagging, 1), "SOD": (MV.sod, 2), "ROD": (MV.rod, 3)}
#: Models of one column that come from the same module.
ALONG_ORDER = {
    "LOCI": MV.loci, "LMDD": lambda data, key: MV.lmdd(data, key, ["x"]), "SOD": lambda data, key: MV.sod(data, key, ["x"]),
    "FB": lambda data, key: MV.feature_bagging(data, key, ["x"]), "SOS": lambda data, key: MV.sos(data, key, ["x"]),
}
MODELS = [*EXACT, *SAMPLED, *ALONG_ORDER, "SUOD"]


def preprocess(df: DataFrame, columns: Sequence[str], key: Sequence[str]) -> DataFrame:
    """(key..., columns...) as z-scores (population).

    Text is read as numbers; columns without any number are dropped; gaps take the mode.
    Modes and moments are one job each for all columns.
    """
    number = {
        c: F.col(c).cast("double") if isinstance(df.schema[c].dataType, NumericType) else F.col(c).cast("string").try_cast("double")
        for c in columns
    }
    data = df.select(*key, *[F.nanvl(x, F.lit(None).cast("double")).alias(c) for c, x in number.items()])
    known = data.selectExpr(*[f"count(`{c}`) AS `{c}`" for c in columns], "count(*) AS _n").first()
    columns = [c for c in columns if known[c]]
    gaps = [c for c in columns if known[c] < known["_n"]]
    modes = column_modes(data, gaps) if gaps else {}
    data = data.select(*key, *[F.coalesce(F.col(c), F.lit(modes[c])).alias(c) if c in modes else F.col(c) for c in columns])
    row = data.selectExpr(*[x for i, c in enumerate(columns) for x in (f"avg(`{c}`) m{i}", f"stddev_pop(`{c}`) s{i}")]).first()
    return data.select(*key, *[
        ((F.col(c) - row[f"m{i}"]) / (row[f"s{i}"] or 1.0)).alias(c) for i, c in enumerate(columns)
    ])


def score(data: DataFrame, model: str, key: Sequence[str]) -> DataFrame:
    """(key..., x) -> with ``score``."""
    if model in EXACT:
        return EXACT[model](data, key)
    if model in ALONG_ORDER:
        return ALONG_ORDER[model](data, key)
    if model in SAMPLED:
        return score_sampled(data, ["x"], key, model)
    if model == "SUOD":
        return _mean_of_models(data, key)
    raise ValueError(f"unknown model {model}")


def _mean_of_models(data: DataFrame, key: Sequence[str]) -> DataFrame:
    """Mean of the standardised scores of several detectors, as one grouped sum."""
    data, parts = cut_lineage(data), []
    for m in SUOD_BASE:
        s = cut_lineage(score(data, m, key).select(*key, "x", "score"))
        mean, std = s.agg(F.avg("score"), F.stddev_pop("score")).first()
        parts.append(s.withColumn("score", (F.col("score") - mean) / (std or 1.0)))
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy(*key).agg(F.max("x").alias("x"), F.avg("score").alias("score"))


def label(scored: DataFrame, model: str, contamination: float = CONTAMINATION) -> DataFrame:
    """Add 0/1 ``label``: above 3.5 for MAD, else above the exact (1 - contamination) quantile."""
    if model == "MAD":
        return scored.withColumn("label", (F.col("score") > MAD_THRESHOLD).cast("int"))
    scored = cut_lineage(scored)  # scores are read several times from here on
    limit = column_quantiles(scored, ["score"], [1 - contamination])["score"][0]
    return scored.withColumn("label", (F.col("score") > limit).cast("int"))


def detect(df: DataFrame, key: Sequence[str], columns: Sequence[str], models: Sequence[str],
           contamination: float = CONTAMINATION) -> DataFrame:
    """Long table (key..., column, model, score, label)."""
    data = preprocess(df, columns, key)
    present = [c for c in columns if c in data.columns]
    if len(models) * len(present) > 1:  # read by every model and column
        data = cut_lineage(data)
    parts = []
    for m in models:
        if m in WHOLE_TABLE and len(present) >= WHOLE_TABLE[m][1]:
            s = label(WHOLE_TABLE[m][0](data, key, present).select(*key, "score"), m, contamination)
            parts += [s.select(*key, F.lit(c).alias("column"), F.lit(m).alias("model"), "score", "label") for c in present]
            continue
        for c in present:
            one = data.select(*key, F.col(c).alias("x"))
            s = label(score(one, m, key).select(*key, "score"), m, contamination)
            parts.append(s.select(*key, F.lit(c).alias("column"), F.lit(m).alias("model"), "score", "label"))
    return reduce(DataFrame.unionByName, parts)


def labels_by_column(found: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(key..., one 0/1 column per feature): 1 when any model says so."""
    return found.groupBy(*key).agg(*[
        F.max(F.when(F.col("column") == c, F.col("label")).otherwise(0)).alias(c) for c in columns
    ])


def model_counts(found: DataFrame) -> DataFrame:
    """(model, anomalies)."""
    return found.groupBy("model").agg(F.sum("label").alias("anomalies"))


def count_matrix(found: DataFrame, models: Sequence[str]) -> DataFrame:
    """(column, one count per model)."""
    return found.groupBy("column").agg(*[
        F.sum(F.when(F.col("model") == m, F.col("label")).otherwise(0)).alias(m) for m in models
    ])


def anomalous_rows(found: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows with any 1, and only the columns that have any."""
    wide = labels_by_column(found, key, columns)
    hits = {r["column"] for r in found.where("label = 1").select("column").distinct().collect()}
    keep = [c for c in columns if c in hits]
    if not keep:
        return wide.select(*key).limit(0)
    return wide.where(reduce(lambda a, b: a | b, [F.col(c) == 1 for c in keep])).select(*key, *keep)
