"""Quality scores: completeness, consistency, validity."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DateType, NumericType, StringType, TimestampNTZType, TimestampType

WEIGHTS = {"completeness": 0.4, "consistency": 0.4, "validity": 0.2}
MAX_TEXT, FIRST_YEAR, LAST_YEAR = 255, 2014, 2024


def _missing(df: DataFrame) -> DataFrame:
    return df.selectExpr(" + ".join(f"(count(*) - count(`{c}`))" for c in df.columns) + " AS missing")


def completeness_score(original: DataFrame, processed: DataFrame) -> DataFrame:
    """(completeness): how much of the missing cells is gone, 0..1; 1 when none was missing."""
    both = _missing(original).withColumnRenamed("missing", "before").join(_missing(processed))
    return both.select(F.when(F.col("before") == 0, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("before") - F.col("missing")) / F.nullif(F.col("before"), F.lit(0))))
    ).alias("completeness"))


def name_score(columns: list[str]) -> float:
    """Lower-case names first; the case rule then only hits names without letters."""
    names = [c.strip().lower() for c in columns]
    if not names:
        return 0.0
    score = 1.0
    score -= 0.3 * any(re.search(r"[^a-z0-9_]", n) for n in names)
    score -= 0.3 * any(" " in n for n in names)
    score -= 0.2 * (not all(n.islower() for n in names))
    return max(0.0, score)


def consistency_score(df: DataFrame) -> DataFrame:
    """(consistency): 0.6 names + 0.4 types; a string column that mixes numbers and other text
    costs 0.1. All values count, in one pass."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, StringType)]
    number = "count(try_cast(`{c}` AS double))"
    mixed = " + ".join(
        f"int({number.format(c=c)} BETWEEN 1 AND count(`{c}`) - 1)" for c in texts
    ) or "0 * count(*)"
    return df.selectExpr(f"double({0.6 * name_score(df.columns)!r} + 0.4 * greatest(0, 1 - 0.1 * ({mixed}))) AS consistency")


def validity_score(df: DataFrame) -> DataFrame:
    """(validity): share of passed checks; amounts >= 0, dates in range, texts not too long."""
    checks = []
    for f in df.schema:
        c, low = f"`{f.name}`", f.name.lower()
        if any(w in low for w in ("amount", "price", "cost")):
            checks.append(f"coalesce(min({c}) >= 0, true)" if isinstance(f.dataType, NumericType) else "false")
        if any(w in low for w in ("date", "time")):
            is_date = isinstance(f.dataType, (DateType, TimestampType, TimestampNTZType))
            checks.append(
                f"coalesce(year(min({c})) >= {FIRST_YEAR} AND year(max({c})) <= {LAST_YEAR}, false)" if is_date else "false")
        if isinstance(f.dataType, StringType):
            checks.append(f"coalesce(max(length({c})) <= {MAX_TEXT}, true)")
    if not checks:
        return df.limit(0).agg((F.count(F.lit(1)) + 1.0).alias("validity"))
    passed = " + ".join(f"int({x})" for x in checks)
    return df.selectExpr(f"CASE WHEN count(*) = 0 THEN 0D ELSE ({passed}) / {len(checks)}D END AS validity")


def quality_score(original: DataFrame, processed: DataFrame) -> DataFrame:
    """One row: the three scores and their weighted sum."""
    parts = completeness_score(original, processed).join(consistency_score(processed)).join(validity_score(processed))
    return parts.withColumn("score", sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0.0)))
