"""Fuzzy groups of similar terms, exact for the given threshold.

Similarity is ``2 * LCS / (len(a) + len(b))``. Terms within the threshold can differ by at most
``k`` inserted or deleted letters, each of which destroys at most two bigrams, so two similar
terms share one of their ``2k + 1`` rarest bigrams. Joining on those rare bigrams gives every
similar pair and few others.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import DoubleType

from millrace.operators import values as V
from millrace.session import cut_lineage


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, one machine-word step per letter of ``b``."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(DoubleType())
def indel_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in pairs:
        yield pd.Series([
            200.0 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 100.0 for a, b in zip(left, right)
        ])


def _bigrams(term: str) -> Column:
    """Numbered bigrams: the second "an" of a term is another element than the first."""
    padded = F.concat(F.lit("\x02"), F.col(term), F.lit("\x03"))
    grams = F.transform(F.sequence(F.lit(1), F.length(term) + 1), lambda i: F.substr(padded, i, F.lit(2)))
    return F.transform(
        grams, lambda g, i: F.concat(g, F.size(F.filter(F.slice(grams, 1, i + 1), lambda h: h == g)).cast("string")))


def similar_pairs(terms: DataFrame, threshold: float = 90) -> DataFrame:
    """(a, b, ratio) for every two different terms at or above the threshold, both directions."""
    t = threshold / 100
    if t <= 0.75:
        raise ValueError("the threshold must be above 75: below, similar terms may share no bigram")
    grams = terms.select("term", F.length("term").alias("n"), F.explode(_bigrams("term")).alias("gram"))
    freq = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("freq"))
    # The longest partner of a term of length n has n * (2 - t) / t letters.
    edits = F.floor(F.col("n") * (2 * (1 - t) / t) + 1e-9)
    per = grams.join(freq, "gram").groupBy("term", "n").agg(F.array_sort(F.collect_list(F.struct("freq", "gram"))).alias("g"))
    rare = per.select("term", "n", F.explode(F.slice("g", F.lit(1), (2 * edits + 1).cast("int"))).alias("x")).select("term", "n", "x.gram")
    a, b = rare.alias("a"), rare.alias("b")
    most = F.least(F.col("a.n"), F.col("b.n")) * 2 / (F.col("a.n") + F.col("b.n"))
    # AQE splits the join partition of a bigram that many terms share.
    pairs = a.join(b, (F.col("a.gram") == F.col("b.gram")) & (F.col("a.term") < F.col("b.term")) & (most >= t - 1e-12))
    pairs = pairs.select(F.col("a.term").alias("a"), F.col("b.term").alias("b")).distinct()
    close = pairs.withColumn("ratio", indel_ratio("a", "b")).where(F.col("ratio") >= threshold - 1e-9)
    return close.unionByName(close.select(F.col("b").alias("a"), F.col("a").alias("b"), "ratio"))


def group_similar(terms: DataFrame, order: str, threshold: float = 90, max_group_size: int = 5) -> DataFrame:
    """(representative, term, place): greedy groups in ascending ``order``.

    A term that nobody took before becomes a representative and takes those of its
    ``max_group_size`` best matches (itself included) that are still free. Whether a term is
    taken depends only on earlier terms that list it, so terms are settled in rounds: all whose
    earlier listers are settled at once. ``terms`` has ``term`` and the order column.
    """
    place = terms.select("term", F.col(order).alias("pos"))
    pairs = similar_pairs(terms.select("term"), threshold)
    at = place.select(F.col("term").alias("b"), F.col("pos").alias("b_pos"))
    # Every task keeps only its best few rows per term before the shuffle (WindowGroupLimit).
    best = W.partitionBy("a").orderBy(F.desc("ratio"), "b_pos")
    listed = pairs.join(at, "b").withColumn("i", F.row_number().over(best)).where(
        F.col("i") < max_group_size).select("a", (F.col("i") + 1).alias("place"), "b", "b_pos")
    lists = listed.join(place.select(F.col("term").alias("a"), F.col("pos").alias("a_pos")), "a")
    lists = cut_lineage(lists.where("a_pos < b_pos"))  # a later lister cannot take an earlier term
    state = cut_lineage(
        place.join(lists.select(F.col("b").alias("term")).distinct(), "term", "left_anti")
        .select("term", F.lit(True).alias("rep")))
    open_ = cut_lineage(place.join(state, "term", "left_anti").select("term"))
    while not open_.isEmpty():  # the earliest open term is settled in every round
        votes = lists.join(open_.select(F.col("term").alias("b")), "b", "left_semi").join(
            state.select(F.col("term").alias("a"), "rep"), "a", "left")
        done = votes.groupBy("b").agg(
            F.max("rep").alias("taken"), F.count_if(F.col("rep").isNull()).alias("waiting"),
        ).where("waiting = 0 OR taken").select(F.col("b").alias("term"), (~F.coalesce("taken", F.lit(False))).alias("rep"))
        state = cut_lineage(state.unionByName(done))
        open_ = cut_lineage(place.join(state, "term", "left_anti").select("term"))
    reps = state.where("rep").select(F.col("term").alias("a"))
    taken = lists.join(reps, "a", "left_semi").groupBy("b").agg(F.min(F.struct("a_pos", "a", "place")).alias("x"))
    members = taken.select(F.col("x.a").alias("representative"), F.col("b").alias("term"), F.col("x.place").alias("place"))
    members = members.join(reps.select(F.col("a").alias("term")), "term", "left_anti")
    return members.select("representative", "term", "place").unionByName(
        reps.select(F.col("a").alias("representative"), F.col("a").alias("term"), F.lit(1).alias("place")))


def standard_terms(terms: DataFrame, order: str, vocabulary: DataFrame, threshold: float = 90) -> DataFrame:
    """(term, fixed): each fuzzy group takes its most frequent spell-corrected form."""
    groups = group_similar(terms, order, threshold)
    cleaned = groups.withColumn("clean", V.clean_text(F.col("term")))
    fixes = V.term_corrections(cleaned.select(F.col("clean").alias("term")).distinct(), vocabulary)
    forms = cleaned.join(fixes.withColumnRenamed("term", "clean"), "clean", "left").select(
        "representative", "term", "place", F.coalesce("fixed", "clean").alias("form"))
    count = forms.groupBy("representative", "form").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    best = count.groupBy("representative").agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "form"))["form"].alias("fixed"))
    return forms.join(best, "representative").select("term", "fixed")
