"""Mixing sources to target weights.

Targets come from capped water-filling: every source gets its weight's share of the budget, sources beyond their maximum of
epochs are clamped there, and what they leave is shared by weight among the others until no source is above its cap. A source
whose target is ``r`` epochs takes each document ``floor(r)`` times, and a seeded choice of documents once more until the
words taken come as near to the target as whole documents allow.

The seeded order of a source is that of an MD5 of seed and id, so reruns agree. Running sums along it are taken over hash
buckets first and inside the one bucket that holds the border second, so no task sorts a whole source.

Null texts have size 0. A null source is a source of its own and comes last. Repeated rows are documents of their own.
An empty table gives an empty result; if no source has words, every target is 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from millrace.llm.common import ROW, TEXT, carried, words
from millrace.session import cut_lineage

MAX_EPOCHS = 3.0
SEED = 11
WEIGHTS = (5.0, 2.0, 1.0)


def source_sizes(sized: DataFrame) -> DataFrame:
    return sized.groupBy("_llm_source").agg(F.sum("_llm_size").alias("_llm_source_size"), F.count(F.lit(1)).alias("_llm_rows"))


def repeating_weights(sources: DataFrame, pattern: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Weights for sources (one row each) in code point order, null last, the pattern repeating."""
    place = F.row_number().over(W.orderBy(F.col("_llm_source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(w) for w in pattern])
    return sources.withColumn("_llm_weight", F.get(weights, (place % len(pattern)).cast("int")))


def water_fill(sources: DataFrame, budget: float | None = None, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Add ``_llm_target``; ``sources`` has a row per source with its size and weight and is read once a round.

    Each round clamps the sources whose share lies above their cap and shares out the rest anew; only four sums a round reach
    the driver. A clamped source stays clamped, so rounds are at most the number of sources, and few in practice.
    """
    cap = F.col("_llm_source_size") * max_epochs
    level, weight = math.inf, F.col("_llm_weight")
    total = budget
    while True:
        full = (weight * level > cap) if level < math.inf else F.lit(False)
        got = sources.agg(
            F.sum("_llm_source_size"), F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(weight))).first()
        if not got[0]:
            return sources.withColumn("_llm_target", F.lit(0.0))
        total = float(got[0]) if total is None else total
        if not got[2]:
            break  # every source is at its cap
        next_level = max(0.0, total - got[1]) / got[2]
        if level < math.inf and next_level <= level:
            break
        level = next_level
    return sources.withColumn("_llm_target", F.least(weight * level, cap))


def _order(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null"))))


def copies(
    docs: DataFrame, weights: DataFrame | None = None, key: str = "doc_id", source: str = "source", text: str = "text",
    budget: float | None = None, max_epochs: float = MAX_EPOCHS, seed: int = SEED, keep_row: bool = False,
) -> DataFrame:
    """(key, size, source_size, target, copies) per document, or the whole row in ``ROW`` with its copies.

    ``weights`` has columns ``source`` and ``weight``; without it the pattern ``WEIGHTS`` repeats over the sources.
    ``budget`` is in words (all sizes, if not given).
    """
    narrow = docs if keep_row else docs.select(*dict.fromkeys([key, source, text]))
    sized = carried(narrow, text).select(
        ROW if keep_row else F.struct(F.col(ROW)[key].alias(key)).alias(ROW), F.size(words(F.col(TEXT))).cast("long").alias("_llm_size"), F.col(ROW)[source].alias("_llm_source"),
        _order(F.col(ROW)[key], seed).alias("_llm_order"))
    # What the passes over sizes read is written once: no texts.
    slim = cut_lineage(sized.drop(ROW) if keep_row else sized)
    sources = source_sizes(slim)
    if weights is None:
        sources = repeating_weights(sources)
    else:
        w = weights.select(F.col("source").alias("_llm_w"), F.col("weight").cast("double").alias("_llm_weight"))
        sources = sources.join(w, F.col("_llm_source").eqNullSafe(F.col("_llm_w")), "left").drop("_llm_w").fillna(0.0, ["_llm_weight"])
    sources = cut_lineage(sources.coalesce(1))
    filled = water_fill(sources, budget, max_epochs)
    epochs = F.col("_llm_target") / F.greatest(F.col("_llm_source_size"), F.lit(1))
    filled = filled.withColumns({"_llm_whole": F.floor(epochs), "_llm_part": (epochs - F.floor(epochs)) * F.col("_llm_source_size")})
    # About the square root of the rows: as many buckets as rows in a bucket.
    rows = sources.agg(F.sum("_llm_rows")).first()[0] or 0
    digits = max(1, min(8, math.ceil(math.log(max(rows, 1), 16) / 2)))
    bucket = F.substring("_llm_order", 1, digits)
    by_bucket = slim.groupBy("_llm_source", bucket.alias("_llm_bucket")).agg(F.sum("_llm_size").alias("_llm_n"))
    before = F.sum("_llm_n").over(W.partitionBy("_llm_source").orderBy("_llm_bucket").rowsBetween(W.unboundedPreceding, -1))
    by_bucket = by_bucket.withColumn("_llm_before", F.coalesce(before, F.lit(0)))
    same = lambda a, b: a["_llm_source"].eqNullSafe(b["_llm_source"])
    # The bucket in which a source's extra round ends; earlier buckets are in, later ones out.
    parts = filled.select("_llm_source", "_llm_source_size", "_llm_target", "_llm_whole", "_llm_part")
    border = by_bucket.join(parts, same(by_bucket, parts)).where(
        (F.col("_llm_before") <= F.col("_llm_part")) & (F.col("_llm_part") < F.col("_llm_before") + F.col("_llm_n"))
    ).select(parts["_llm_source"].alias("_llm_b_source"), F.col("_llm_bucket").alias("_llm_border"), "_llm_before", "_llm_part")
    inside = slim.select("_llm_source", "_llm_order", "_llm_size", bucket.alias("_llm_bucket"))
    inside = inside.join(F.broadcast(border) if rows and _small(sources) else border,
                         inside["_llm_source"].eqNullSafe(border["_llm_b_source"]) & (F.col("_llm_bucket") == F.col("_llm_border")))
    run = F.sum("_llm_size").over(W.partitionBy("_llm_source").orderBy("_llm_order", "_llm_size").rowsBetween(W.unboundedPreceding, -1))
    start = F.col("_llm_before") + F.coalesce(run, F.lit(0))
    # A document is in if at least half of it fits. Among rows alike in id and size, how many are in is what counts.
    taken = inside.withColumn("_llm_in", (start + F.col("_llm_size") / 2 <= F.col("_llm_part")) & (F.col("_llm_size") > 0)).where("_llm_in")
    edge = taken.groupBy("_llm_source", "_llm_border").agg(F.max(F.struct("_llm_order", "_llm_size")).alias("_llm_last"))
    filled = border.select("_llm_b_source", "_llm_border").join(
        edge.select(F.col("_llm_source").alias("_llm_e_source"), "_llm_last"), F.col("_llm_b_source").eqNullSafe(F.col("_llm_e_source")), "left"
    ).select("_llm_b_source", "_llm_border", "_llm_last").join(parts, F.col("_llm_b_source").eqNullSafe(F.col("_llm_source")), "right")
    filled = cut_lineage(filled.select(
        F.col("_llm_source").alias("_llm_f_source"), "_llm_source_size", "_llm_target", "_llm_whole", "_llm_part", "_llm_border", "_llm_last").coalesce(1))
    rows_out = sized if keep_row else slim
    out = rows_out.join(F.broadcast(filled) if _small(sources) else filled, rows_out["_llm_source"].eqNullSafe(filled["_llm_f_source"]))
    extra = (F.col("_llm_part") > 0) & F.coalesce(
        (bucket < F.col("_llm_border")) | F.coalesce(F.struct("_llm_order", "_llm_size") <= F.col("_llm_last"), F.lit(False)), F.lit(False))
    out = out.withColumn("copies", (F.col("_llm_whole") + extra.cast("long")).cast("long"))
    if keep_row:
        return out.select(ROW, "copies")
    return out.select(
        F.col(ROW)[key].alias(key), F.col("_llm_size").alias("size"), F.col("_llm_source_size").alias("source_size"),
        F.col("_llm_target").alias("target"), "copies")


#: Sources that one task may look up in memory; beyond, the lookup is a shuffled join.
SMALL_SOURCES = 10_000


def _small(sources: DataFrame) -> bool:
    return sources.limit(SMALL_SOURCES + 1).count() <= SMALL_SOURCES


def mix(docs: DataFrame, weights: DataFrame | None = None, **how) -> DataFrame:
    """The mixed corpus: each document as many times as the mix takes it, all its columns."""
    taken = copies(docs, weights, keep_row=True, **how).where("copies > 0")
    return taken.withColumn("_llm_nth", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(f"{ROW}.*")
