"""Connected components of a table of links, in rounds of star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(u, v)``; the root is the smallest node of its component.

    Each round points every node's larger neighbours, then its smaller ones, at the smallest of them; a component becomes a
    star around its root after about log(nodes) rounds. Minima are aggregated before the shuffle, so a hub is one row per task
    there, and its links are joined to that one row.
    """
    both = lambda e: e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    edges, before = cut_lineage(links.where("u != v").distinct()), None
    while True:
        around = both(edges)
        least = around.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = around.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(large.where("u != v").distinct())
        lower = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = lower.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        small = lower.join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(small.union(least.select("w", "m")).where("u != v").distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
