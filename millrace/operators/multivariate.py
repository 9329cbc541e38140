"""Detectors over several columns at once, and over running sums, for tables of any size.

Neighbourhoods come from the nearest-neighbour join, counts within a radius and deviations along an order from running sums over
ordered buckets, geometric medians from repeated aggregates. Nothing is sampled; a task holds one cell of points or one bucket.
Inputs are standardised columns without gaps, as ``anomaly.preprocess`` makes them; keys must be unique.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from millrace import ordered
from millrace.operators import neighbours
from millrace.quantiles import column_quantiles
from millrace.session import cut_lineage

SEED = 42
LOF_K, BAGS = 20, 10
SOD_K, SOD_REFS, SOD_ALPHA = 20, 10, 0.8
LMDD_ROUNDS = 10
#: Binding reaches the ``SOS_K`` nearest points that differ; the affinity's width is found by halving its logarithm's range.
SOS_K, SOS_PERPLEXITY, SOS_HALVINGS, SOS_RANGE = 15, 4.5, 60, 27.6
#: Sorted points that one task binds, those packed into a block whose counts are looked up, and blocks that ask another one together.
SOS_BLOCK, LOCI_BLOCK, LOCI_PART = 50_000, 25_000, 256
LOCI_ALPHA, LOCI_LEAST = 0.5, 20
#: Radii as shares of the range: from 0.02 to 1 in equal ratios.
LOCI_RADII = tuple(0.02 * 50 ** (i / 7) for i in range(8))
#: Steps of the geometric median, and the move below which it has settled.
MEDIAN_STEPS, MEDIAN_MOVE = 200, 1e-12
#: The ranges to which the angles up to and beyond a right angle are scaled.
ROD_ACUTE, ROD_OBTUSE = (0.001, 0.955), (3.141592653589793 / 2 + 0.001, 2.186)


def _key(key: Sequence[str]):
    return F.struct(*[F.col(f"`{c}`") for c in key])


def local_outlier_factors(df: DataFrame, key: Sequence[str], subsets: Sequence[Sequence[str]], k: int = LOF_K) -> DataFrame:
    """(_g, _id, _lof) by subset of columns: mean density of the k nearest other rows over the row's own.

    A row's factor depends on rows up to three steps away in the graph of neighbours, which two joins along its edges reach.
    """
    near = cut_lineage(neighbours.others(df, key, subsets, k))
    edges = near.select("_g", "_id", F.explode("_near").alias("_e")).select("_g", "_id", F.col("_e._key").alias("_to"), F.col("_e._d").alias("_d"))
    far = near.select("_g", F.col("_id").alias("_to"), F.element_at("_near", -1)["_d"].alias("_k"))
    density = edges.join(far, ["_g", "_to"]).groupBy("_g", "_id").agg((1 / (F.avg(F.greatest("_k", "_d")) + 1e-10)).alias("_own"))
    density = cut_lineage(density)
    around = edges.join(density.select("_g", F.col("_id").alias("_to"), F.col("_own").alias("_there")), ["_g", "_to"]).groupBy("_g", "_id").agg(
        F.avg("_there").alias("_around"))
    return around.join(density, ["_g", "_id"]).select("_g", "_id", (F.col("_around") / F.col("_own")).alias("_lof"))


def bags(columns: Sequence[str], rounds: int = BAGS, seed: int = SEED) -> dict[tuple[str, ...], int]:
    """Random subsets of half to all but one of the columns, and how often each is drawn."""
    rng, out = random.Random(seed), {}
    for _ in range(rounds):
        n = rng.randint(max(1, len(columns) // 2), max(1, len(columns) - 1))
        drawn = tuple(columns[i] for i in sorted(rng.sample(range(len(columns)), n)))
        out[drawn] = out.get(drawn, 0) + 1
    return out


def feature_bagging(df: DataFrame, key: Sequence[str], columns: Sequence[str], k: int = LOF_K, rounds: int = BAGS, seed: int = SEED) -> DataFrame:
    """Add ``score``: the mean local outlier factor over random column subsets, all of them searched by one join."""
    drawn = bags(columns, rounds, seed)
    weight = F.element_at(F.create_map(*[x for g, n in enumerate(drawn.values()) for x in (F.lit(g), F.lit(n / rounds))]), F.col("_g"))
    factors = local_outlier_factors(df, key, list(drawn), k).groupBy("_id").agg(F.sum(F.col("_lof") * weight).alias("score"))
    return df.join(factors, _key(key) == F.col("_id")).drop("_id")


def _bound_along(points: DataFrame, column: str, perplexity: float, k: int) -> DataFrame:
    """(_at, score) of ``sos`` for the points of one column, with ``_m`` copies: the nearest points lie within ``k`` places of the sorted ones.

    A block of sorted points has 2 k more on either side: those within k places may bind to its points and need k places themselves.
    """
    blocks = ordered.blocked(points.select(F.col(f"`{column}`").cast("double").alias("_at"), "_m"), ["_at"], 2 * k, 2 * k, rows=SOS_BLOCK)
    steps = np.r_[-k:0, 1:k + 1]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ordered.POSITION)
        x, m = pdf["_at"].to_numpy(), pdf["_m"].to_numpy(float)
        to = np.arange(len(x))[:, None] + steps
        out = (to < 0) | (to >= len(x))
        to = np.clip(to, 0, len(x) - 1)
        d = np.where(out, np.inf, (x[:, None] - x[to]) ** 2)
        best = np.argsort(d, 1, kind="stable")[:, :k]  # of equally near points the smaller
        # A point's own copies are partners at no distance.
        d = np.column_stack([np.zeros(len(x)), np.take_along_axis(d, best, 1)])
        to = np.column_stack([np.arange(len(x)), np.take_along_axis(to, best, 1)])
        n = np.where(np.isfinite(d), m[to], 0.0)
        n[:, 0] = m - 1
        some = n.sum(1) > 0  # a point alone binds to none
        d, to, n, m_ = d[some], to[some], n[some], m[some]
        away = np.where(n > 0, d - np.where(n[:, 0] > 0, 0.0, d[:, 1])[:, None], 0.0) if len(d) else d
        low, high = np.full(len(d), -SOS_RANGE), np.full(len(d), SOS_RANGE)
        for _ in range(SOS_HALVINGS):
            middle = (low + high) / 2
            far = np.exp(middle)[:, None] * away
            held = n * np.exp(-far)
            z = held.sum(1)
            wide = np.log(z) + (held * far).sum(1) / z > math.log(perplexity)
            low, high = np.where(wide, middle, low), np.where(wide, high, middle)
        bind = np.exp(-np.exp((low + high) / 2)[:, None] * away)
        share = np.minimum(bind / (n * bind).sum(1)[:, None], 1 - 1e-12)
        free = np.repeat(m_[:, None], d.shape[1], 1)
        free[:, 0] -= 1
        free = np.where(n > 0, free * np.log1p(-share), 0.0)
        score = np.exp(np.bincount(to.ravel(), free.ravel(), len(x)))
        return pd.DataFrame({"_at": x, "score": score})[pdf[ordered.HOME].to_numpy(bool)]

    return blocks.groupBy(ordered.BLOCK).applyInPandas(run, "_at double, score double")


def sos(df: DataFrame, key: Sequence[str], columns: Sequence[str], perplexity: float = SOS_PERPLEXITY, k: int = SOS_K) -> DataFrame:
    """Add ``score``: the probability that no other row binds to the row, where each row binds to one at random by nearness.

    Nearness falls off as a Gauss curve whose width gives the row ``perplexity`` partners. Rows at one point are handled as one
    point with a count, so copies bind to each other exactly; of the other points the ``k`` nearest (at least some three times
    the perplexity) are reached and those beyond, whose share is small, are not. Rows with a gap get a null score.
    """
    points = df.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count(F.lit(1)).alias("_m"))
    points = cut_lineage(points.dropna(subset=list(columns)))
    if len(columns) == 1:
        scores = _bound_along(points, columns[0], perplexity, k)
        return df.join(scores, F.col(f"`{columns[0]}`") == F.col("_at"), "left").drop("_at")
    weights = points.select(_key(columns).alias("_id"), "_m")
    edges = neighbours.others(points, columns, [list(columns)], k).select("_id", F.explode("_near").alias("_e"))
    edges = edges.select("_id", F.col("_e._key").alias("_to"), (F.col("_e._d") ** 2).alias("d")).join(
        weights.select(F.col("_id").alias("_to"), F.col("_m").alias("n")), "_to")
    # A point's own copies are partners at no distance.
    copies = weights.where("_m > 1").select("_id", F.col("_id").alias("_to"), F.lit(0.0).alias("d"), (F.col("_m") - 1).alias("n"))
    near = edges.select("_id", "_to", "d", "n").unionByName(copies).groupBy("_id").agg(
        F.array_sort(F.collect_list(F.struct("d", "n", F.col("_to").alias("to")))).alias("_near"))
    near = near.withColumn("_away", F.transform("_near", lambda s: F.struct((s["d"] - F.get("_near", F.lit(0))["d"]).alias("d"), s["n"].alias("n"))))

    def total(beta, term):
        return F.aggregate("_away", F.lit(0.0), lambda a, s: a + s["n"] * term(beta * s["d"]))

    def halve(span, _):
        middle = (span["low"] + span["high"]) / 2
        z = total(F.exp(middle), lambda x: F.exp(-x))
        wide = F.ln(z) + total(F.exp(middle), lambda x: x * F.exp(-x)) / z > math.log(perplexity)
        return F.struct(F.when(wide, middle).otherwise(span["low"]).alias("low"), F.when(wide, span["high"]).otherwise(middle).alias("high"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(SOS_HALVINGS)), F.struct(F.lit(-SOS_RANGE).alias("low"), F.lit(SOS_RANGE).alias("high")), halve,
                        lambda span: F.exp((span["low"] + span["high"]) / 2))
    near = cut_lineage(near.withColumn("_beta", found)).withColumn("_z", total(F.col("_beta"), lambda x: F.exp(-x)))
    binds = near.join(weights, "_id").select("_id", "_m", "_z", "_beta", F.posexplode("_near").alias("_at", "_e"), F.get("_near", F.lit(0))["d"].alias("_least"))
    own = F.col("_e.to") == F.col("_id")
    share = F.least(F.exp(-F.col("_beta") * (F.col("_e.d") - F.col("_least"))) / F.col("_z"), F.lit(1 - 1e-12))
    free = binds.select(F.col("_e.to").alias("_id"), (F.when(own, F.col("_m") - 1).otherwise(F.col("_m")) * F.log1p(-share)).alias("_l"))
    scores = weights.join(free.groupBy("_id").agg(F.sum("_l").alias("_l")), "_id", "left").select(
        F.col("_id").alias("_at"), F.exp(F.coalesce("_l", F.lit(0.0))).alias("score"))
    return df.join(scores, _key(columns) == F.col("_at"), "left").drop("_at")


def sod(df: DataFrame, key: Sequence[str], columns: Sequence[str], k: int = SOD_K, refs: int = SOD_REFS, alpha: float = SOD_ALPHA) -> DataFrame:
    """Add ``score``: distance from the mean of the reference rows, in the columns in which these vary little.

    The references of a row are those ``refs`` of its ``k`` nearest rows that share most nearest rows with it (ties to the smaller
    key). A column counts if their variance in it is below ``alpha`` times the mean over all columns; where none does, as with a
    single column, the score is 0.
    """
    near = cut_lineage(neighbours.others(df, key, [list(columns)], k).select("_id", F.transform("_near", lambda s: s["_key"]).alias("_list")))
    there = near.select(F.col("_id").alias("_to"), F.col("_list").alias("_theirs"))
    shared = near.select("_id", "_list", F.explode("_list").alias("_to")).join(there, "_to").select(
        "_id", F.struct((-F.size(F.array_intersect("_list", "_theirs"))).alias("n"), F.col("_to").alias("key")).alias("_s"))
    chosen = shared.groupBy("_id").agg(F.slice(F.array_sort(F.collect_list("_s")), 1, refs).alias("_refs"))
    points = df.select(_key(key).alias("_to"), F.array(*[F.col(f"`{c}`") for c in columns]).alias("_x"))
    places = chosen.select("_id", F.explode("_refs.key").alias("_to")).join(points, "_to")
    stats = places.groupBy("_id").agg(*[x for j in range(len(columns)) for x in (
        F.avg(F.get("_x", F.lit(j))).alias(f"_m{j}"), F.var_pop(F.get("_x", F.lit(j))).alias(f"_v{j}"))])
    both = df.join(stats, _key(key) == F.col("_id"), "left")
    mean = reduce(lambda a, b: a + b, [F.col(f"_v{j}") for j in range(len(columns))]) / len(columns)
    low = [F.col(f"_v{j}") < alpha * mean for j in range(len(columns))]
    total = reduce(lambda a, b: a + b, [F.when(u, F.pow(F.col(f"`{c}`") - F.col(f"_m{j}"), F.lit(2))).otherwise(0.0) for j, (c, u) in enumerate(zip(columns, low))])
    n = reduce(lambda a, b: a + b, [F.when(u, 1).otherwise(0) for u in low])
    return both.select(*df.columns, F.when(n > 0, F.sqrt(total) / n).otherwise(0.0).alias("score"))


def lmdd(df: DataFrame, key: Sequence[str], columns: Sequence[str], rounds: int = LMDD_ROUNDS) -> DataFrame:
    """Add ``score``: the largest gain in dissimilarity that the row brings to the rows before it, over several orders by key hash.

    Dissimilarity is the variance, summed over columns, of the rows up to a place; the gain of the n-th row is n times its growth.
    Both come from running sums along the order. The first row of an order gains nothing.
    """
    name = F.concat_ws("|", *[F.col(f"`{c}`").cast("string") for c in key])
    each = df.select(*key, *columns, F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("_r")).withColumn(
        "_o", F.unhex(F.md5(F.concat(name, F.lit("|"), F.col("_r").cast("string")))))
    # Hashes are spread evenly, so their first four bytes cut the order into parts of about equal size.
    rows = df.count()
    part = F.floor(F.conv(F.substring(F.hex("_o"), 1, 8), 16, 10).cast("long") * F.lit(max(1, -(-rows // ordered.part_rows(df)))) / F.lit(1 << 32))
    sums = {"_n": F.lit(1)} | {f"_{p}{j}": F.pow(F.col(f"`{c}`"), F.lit(p)) for j, c in enumerate(columns) for p in (1, 2)}
    run = ordered.running_sum(each, ["_o", *key], sums, ["_r"], bucket=part)
    now, before = F.lit(0.0), F.lit(0.0)
    for j, c in enumerate(columns):
        n, s1, s2, x = F.col("_n"), F.col(f"_1{j}"), F.col(f"_2{j}"), F.col(f"`{c}`")
        now = now + s2 / n - F.pow(s1 / n, F.lit(2))
        before = before + (s2 - x * x) / F.nullif(n - 1, F.lit(0)) - F.pow((s1 - x) / F.nullif(n - 1, F.lit(0)), F.lit(2))
    gains = run.select(_key(key).alias("_id"), F.coalesce(F.col("_n") * (now - before), F.lit(0.0)).alias("_gain"))
    best = gains.groupBy("_id").agg(F.max("_gain").alias("score"))
    return df.join(best, _key(key) == F.col("_id")).drop("_id")


def _counted_within(blocks: DataFrame, before: dict[int, np.ndarray], steps: Sequence[tuple[int, float]], factor: float, powers: int) -> DataFrame:
    """(_b, _i, _side, _from, _s0 ..): for the sorted values of every block, from place ``_from`` on, running sums at both ends of the
    interval of ``factor`` times each radius about them: of the copies ``_c`` and, by power up to ``powers``, of ``_c`` times ``_own`` to it.

    An end lies among the values of one block, and the ends of a block's values in consecutive blocks: each such run of ends goes to the
    block that answers it, in parts of ``LOCI_PART`` asking blocks. Ends before all values have no row. ``before`` holds for every block its
    first value and, by power and radius, the sums over the blocks before it; it is sent to every task.
    """
    order = sorted(before, key=lambda b: before[b][0])
    firsts, many = np.array([before[b][0] for b in order]), len(steps)

    def ask(batches):
        for batch in batches:
            for b, v in zip(batch["_b"], batch["_v"]):
                for i, r in steps:
                    for side in (-1, 1):
                        at = v + side * factor * r
                        there = np.searchsorted(firsts, at, "right" if side > 0 else "left") - 1
                        starts = np.flatnonzero(np.r_[True, there[1:] != there[:-1]])
                        ends = np.r_[starts[1:], len(at)]
                        out = [(order[there[s]], i, b // LOCI_PART, b, side, int(s), at[s:e]) for s, e in zip(starts, ends) if there[s] >= 0]
                        yield pd.DataFrame(out, columns=["_to", "_i", "_part", "_b", "_side", "_from", "_ends"])

    asked = cut_lineage(blocks.select("_b", "_v").mapInPandas(ask, "_to long, _i int, _part long, _b long, _side int, _from long, _ends array<double>"))
    wanted = asked.select(F.col("_to").alias("_t"), F.col("_i").alias("_r"), F.col("_part").alias("_q")).distinct()
    points = blocks.drop("_t").join(wanted, F.col("_b") == F.col("_t")).select(
        "_t", "_r", "_q", "_v", "_c", *([F.get("_own", F.col("_r")).alias("_own")] if powers else []))
    names = [f"_s{p}" for p in range(powers + 1)]

    def answer(kept: tuple, asking: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        to, i, _ = kept
        v, c = block["_v"].iloc[0], block["_c"].iloc[0]
        at = [np.searchsorted(v, e, "right" if side > 0 else "left") - 1 for e, side in zip(asking["_ends"], asking["_side"])]
        out = asking[["_b", "_i", "_side", "_from"]]
        for p, name in enumerate(names):
            sums = before[to][1 + p * many + i] + np.cumsum(c * block["_own"].iloc[0] ** p if p else c)
            out = out.assign(**{name: [sums[x] for x in at]})
        return out

    return asked.groupBy("_to", "_i", "_part").cogroup(points.groupBy("_t", "_r", "_q")).applyInPandas(
        answer, "_b long, _i int, _side int, _from long, " + ", ".join(f"{n} array<double>" for n in names))


def _sums_before(blocks: DataFrame) -> dict[int, np.ndarray]:
    """By block the first value, and the sums ``_t`` over the blocks before it: a few numbers a block."""
    out, total = {}, 0.0
    for b, first, t in blocks.select("_b", F.get("_v", F.lit(0)), "_t").orderBy("_b").collect():
        out[b] = np.append(first, np.zeros(len(t)) + total)
        total = total + np.array(t)
    return out


def _between(part: pd.DataFrame, name: str, size: int, radii: int) -> np.ndarray:
    """By radius and value the running sum at the upper end of the interval less that at the lower end."""
    out = np.zeros((radii, size))
    for i, side, at, found in zip(part["_i"], part["_side"], part["_from"], part[name]):
        out[i, at:at + len(found)] += side * found
    return out


def loci(df: DataFrame, key: Sequence[str], alpha: float = LOCI_ALPHA, radii: Sequence[float] = LOCI_RADII, least: int = LOCI_LEAST) -> DataFrame:
    """Add ``score`` to (key..., x): by how many standard deviations a row's count within alpha * r falls short of the mean count of the
    rows within r, at the worst of a few radii (shares of the range) at which at least ``least`` rows are that near.

    Counts are differences of running counts at both ends of the interval. Sorted values are packed into blocks; the ends go to the
    blocks that hold them as whole runs, where they are looked up; equal values are one point.
    """
    values = cut_lineage(df.groupBy(F.col("x").cast("double").alias("_v")).agg(F.count(F.lit(1)).cast("double").alias("_c")).where("_v IS NOT NULL"))
    low, high = values.agg(F.min("_v"), F.max("_v")).first()
    spread = (high - low or 1.0) if high is not None else 1.0
    steps = [(i, float(r * spread)) for i, r in enumerate(radii)]
    placed = ordered.with_position(values, ["_v"], name="_at").withColumn("_b", F.floor(F.col("_at") / LOCI_BLOCK))
    packed = placed.groupBy("_b").agg(F.array_sort(F.collect_list(F.struct("_v", "_c"))).alias("_s")).select(
        "_b", F.col("_s._v").alias("_v"), F.col("_s._c").alias("_c"))
    many = len(steps)
    copies = F.aggregate("_c", F.lit(0.0), lambda a, c: a + c)
    packed = cut_lineage(packed.withColumn("_t", F.array_repeat(copies, many)))

    def own(kept: tuple, found: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        v, c = block["_v"].iloc[0], block["_c"].iloc[0]
        counts = _between(found, "_s0", len(v), many)
        totals = [(c * counts[i] ** p).sum() for p in range(3) for i in range(many)]
        return pd.DataFrame({"_b": [kept[0]], "_v": [v], "_c": [c], "_own": [list(counts)], "_t": [totals]})

    near = _counted_within(packed, _sums_before(packed), steps, alpha, 0).groupBy("_b").cogroup(packed.groupBy("_b")).applyInPandas(
        own, "_b long, _v array<double>, _c array<double>, _own array<array<double>>, _t array<double>")
    near = cut_lineage(near)

    def scored(kept: tuple, found: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        v, counts = block["_v"].iloc[0], np.stack(block["_own"].iloc[0])
        n, first, second = (_between(found, f"_s{p}", len(v), many) for p in range(3))
        mean, square = first / n, second / n
        # Counts are whole numbers: a variance below a billionth of the square is rounding.
        var = square - mean * mean
        some = (var > 1e-9 * square) & (n >= least)
        return pd.DataFrame({"_w": v, "score": np.where(some, (mean - counts) / np.sqrt(np.where(some, var, 1.0)), 0.0).clip(min=0.0).max(0)})

    best = _counted_within(near, _sums_before(near), steps, 1.0, 2).groupBy("_b").cogroup(near.select("_b", "_v", "_own").groupBy("_b")).applyInPandas(
        scored, "_w double, score double")
    return df.join(best, F.col("x") == F.col("_w"), "left").drop("_w")


def geometric_medians(df: DataFrame, triples: Sequence[tuple[str, str, str]], steps: int = MEDIAN_STEPS, move: float = MEDIAN_MOVE) -> list[tuple[float, float, float]]:
    """The point of least summed distance for each triple of columns: one aggregate a step for all triples, from the mean on.

    A row at the point itself weighs nothing in that step. A step moves the point to the mean weighted by inverse distance.
    """
    first = df.agg(*[F.avg(F.col(f"`{c}`")).alias(f"m{i}{j}") for i, t in enumerate(triples) for j, c in enumerate(t)]).first()
    at = [tuple(first[f"m{i}{j}"] or 0.0 for j in range(3)) for i in range(len(triples))]
    for _ in range(steps):
        sums = []
        for i, (t, p) in enumerate(zip(triples, at)):
            gaps = [F.col(f"`{c}`") - F.lit(v) for c, v in zip(t, p)]
            w = F.try_divide(F.lit(1.0), F.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2]))
            sums += [F.sum(w).alias(f"w{i}"), *[F.sum(w * F.col(f"`{c}`")).alias(f"s{i}{j}") for j, c in enumerate(t)]]
        got = df.agg(*sums).first()
        new = [tuple(got[f"s{i}{j}"] / got[f"w{i}"] for j in range(3)) if got[f"w{i}"] else p for i, p in enumerate(at)]
        far = max(max(abs(a - b) for a, b in zip(x, y)) for x, y in zip(at, new))
        at = new
        if far < move:
            break
    return at


def rod(df: DataFrame, key: Sequence[str], columns: Sequence[str], steps: int = MEDIAN_STEPS) -> DataFrame:
    """Add ``score``: rotation costs about the geometric median, as median deviations, averaged over all triples of columns.

    The cost of a row is |v|^3 cos(a) sin(a)^2, where v leads from the median to the row and a is its angle with the median's own
    direction, scaled apart for acute and obtuse angles. Needs at least three columns.
    """
    if len(columns) < 3:
        raise ValueError("rotation needs at least three columns")
    df, triples = cut_lineage(df), list(combinations(columns, 3))
    centres = geometric_medians(df, triples, steps)
    names = [f"_a{i}" for i in range(len(triples))]
    turned = df
    for i, (t, p) in enumerate(zip(triples, centres)):
        v = [F.col(f"`{c}`") - F.lit(m) for c, m in zip(t, p)]
        size = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
        axis = sum(m * m for m in p) ** 0.5
        dot = v[0] * p[0] + v[1] * p[1] + v[2] * p[2]
        cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(dot, size * axis), F.lit(0.0))))
        turned = turned.withColumns({f"_v{i}": size, f"_a{i}": F.acos(cosine)})
    turned = cut_lineage(turned)
    right = ROD_OBTUSE[0] - 0.001
    acute = lambda a: F.when(F.col(a) <= right, F.col(a))
    obtuse = lambda a: F.when(F.col(a) > right, F.col(a))
    edges = turned.agg(*[f(part(a)).alias(f"{n}{a}") for a in names for part, n in ((acute, "l"), (obtuse, "h")) for f, n in ((F.min, n + "0"), (F.max, n + "1"))]).first()

    def scaled(a: str, part: str, to: tuple[float, float]):
        lo, hi = edges[f"{part}0{a}"], edges[f"{part}1{a}"]
        if lo is None:
            return F.lit(to[0])
        return (F.col(a) - lo) / ((hi - lo) or 1.0) * (to[1] - to[0]) + to[0]

    costs = {}
    for i, a in enumerate(names):
        angle = F.when(F.col(a) <= right, scaled(a, "l", ROD_ACUTE)).otherwise(scaled(a, "h", ROD_OBTUSE))
        costs[f"_c{i}"] = F.pow(F.col(f"_v{i}"), F.lit(3)) * F.cos(angle) * F.pow(F.sin(angle), F.lit(2))
    turned = cut_lineage(turned.select(*df.columns, *[c.alias(n) for n, c in costs.items()]))
    middle = column_quantiles(turned, list(costs), [0.5])
    away = turned.select(*df.columns, *[F.abs(F.col(n) - F.lit(middle[n][0])).alias(n) for n in costs])
    away = cut_lineage(away)
    spread = column_quantiles(away, list(costs), [0.5])
    terms = [F.col(n) * (0.6745 / spread[n][0]) if spread[n][0] else F.lit(0.0) for n in costs]
    return away.select(*df.columns, (reduce(lambda a, b: a + b, terms) / len(terms)).alias("score"))
