"""Exact one-column anomaly detectors.

Every detector takes a table (key..., x) with ``x`` standardised and no nulls, and returns it
with ``score``; larger is more anomalous. Sorted neighbours, running sums and counts per
distinct value replace pairwise distances, so nothing grows faster than a sort.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from millrace import ordered
from millrace.quantiles import column_quantiles
from millrace.session import cut_lineage

KNN_K, LOF_K, ABOD_K = 5, 20, 5
HIST_BINS, HIST_ALPHA = 10, 0.1
BLOCK_ROWS = 100_000  # a few dozen neighbours of each row of a block fit one task
#: Kernel sums: cell width in bandwidths, terms of the series, cells looked at on either side, and how many cells (of 15 numbers) are sent whole.
KDE_CELL, KDE_TERMS, KDE_REACH, KDE_SMALL = 0.5, 15, 20, 20_000


def mad(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """0.6745 * |x - median| / median absolute deviation."""
    med = column_quantiles(df, ["x"], [0.5])["x"][0]
    dev = df.select(F.abs(F.col("x") - med).alias("d"))
    spread = column_quantiles(dev, ["d"], [0.5])["d"][0]
    return df.withColumn("score", 0.6745 * F.abs(F.col("x") - med) / (spread or 1.0))


def _histogram(df: DataFrame) -> tuple[float, float, dict[int, int], int]:
    lo, hi, n = df.agg(F.min("x"), F.max("x"), F.count("x")).first()
    width = (hi - lo) / HIST_BINS or 1.0
    rows = df.groupBy(_bin(F.col("x"), lo, width).alias("b")).count().collect()  # at most HIST_BINS rows
    return lo, width, {r["b"]: r["count"] for r in rows}, n


def _bin(x: Column, lo: float, width: float) -> Column:
    return F.least(F.floor((x - lo) / width), F.lit(HIST_BINS - 1)).cast("int")


def _by_bin(df: DataFrame, lo: float, width: float, scores: dict[int, float]) -> DataFrame:
    return df.withColumn("score", F.get(F.array(*[F.lit(scores[b]) for b in range(HIST_BINS)]), _bin(F.col("x"), lo, width)))


def hbos(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """-log2(bin density + alpha) of an equal-width histogram."""
    lo, width, counts, n = _histogram(df)
    return _by_bin(df, lo, width, {b: -math.log2(counts.get(b, 0) / (n * width) + HIST_ALPHA) for b in range(HIST_BINS)})


def loda(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Random one-dimensional projections only scale a single column and leave its equal-width
    bins as they are, so all cuts agree: -log of the bin's share."""
    lo, width, counts, n = _histogram(df)
    return _by_bin(df, lo, width, {b: -math.log(counts.get(b, 0) / n + 1e-12) for b in range(HIST_BINS)})


def _tails(df: DataFrame) -> DataFrame:
    """(x, left, right): -log of both empirical tails per distinct value."""
    counts = cut_lineage(df.groupBy("x").agg(F.count(F.lit(1)).alias("c")))
    run = ordered.running_sum(counts, ["x"], {"cum": F.col("c")}, totals={"n": F.col("c")})
    return run.select(
        "x", (-F.ln(F.col("cum") / F.col("n"))).alias("left"),
        (-F.ln((F.col("n") - F.col("cum") + F.col("c")) / F.col("n"))).alias("right"))


def _skewed_tail(df: DataFrame) -> Column:
    skew = df.agg(F.skewness("x")).first()[0] or 0.0
    return F.col("left") if skew < 0 else F.col("right") if skew > 0 else F.col("left") + F.col("right")


def ecod(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """The larger of both tails and the tail the skew points to."""
    out = df.join(_tails(df), "x")
    return out.withColumn("score", F.greatest("left", "right", _skewed_tail(df))).drop("left", "right")


def copod(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """The larger of the mean of both tails and the tail the skew points to."""
    out = df.join(_tails(df), "x")
    both = (F.col("left") + F.col("right")) / 2
    return out.withColumn("score", F.greatest(both, _skewed_tail(df))).drop("left", "right")


def knn(df: DataFrame, key: Sequence[str], k: int = KNN_K) -> DataFrame:
    """Distance to the k-th nearest other row (the farthest where there are fewer; null for a single row)."""
    def compute(x: np.ndarray) -> np.ndarray:
        return _nearest(x, k)[0][:, -1] if len(x) > 1 else np.full(len(x), np.nan)

    return _by_block(df, key, k, compute)


def _by_block(df: DataFrame, key: Sequence[str], reach: int, compute: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``compute`` on the sorted values of bounded blocks, each with ``reach`` rows on either side."""
    blocks = ordered.blocked(df.select(*key, "x"), ["x", *key], reach, reach, rows=BLOCK_ROWS)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ordered.POSITION)
        return pdf.assign(score=compute(pdf["x"].to_numpy())).loc[pdf[ordered.HOME], [*key, "x", "score"]]

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [*key, "x"])
    return blocks.groupBy(ordered.BLOCK).applyInPandas(run, f"{kinds}, score double")


def _nearest(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distances, places) of the k nearest other values of a sorted array, the earlier on ties."""
    steps = np.r_[-k:0, 1:k + 1]
    at = np.arange(len(x))[:, None] + steps
    out = (at < 0) | (at >= len(x))
    at = np.clip(at, 0, len(x) - 1)
    d = np.where(out, np.inf, np.abs(x[at] - x[:, None]))
    best = np.argsort(d, 1, kind="stable")[:, :min(k, len(x) - 1)]
    return np.take_along_axis(d, best, 1), np.take_along_axis(at, best, 1)


def lof(df: DataFrame, key: Sequence[str], k: int = LOF_K) -> DataFrame:
    """Local outlier factor: mean density of the k nearest rows over the row's own."""
    def compute(x: np.ndarray) -> np.ndarray:
        if len(x) < 2:
            return np.ones(len(x))
        d, at = _nearest(x, k)
        dens = 1 / (np.maximum(d[:, -1][at], d).mean(1) + 1e-10)
        return dens[at].mean(1) / dens

    # The neighbours of neighbours of neighbours of a row lie within 3 k rows.
    return _by_block(df, key, 3 * k, compute)


def abod(df: DataFrame, key: Sequence[str], k: int = ABOD_K) -> DataFrame:
    """Minus the variance of 1 / (a * b) over pairs of the k nearest rows at signed distances a, b;
    rows at the same place are left out, and a row with fewer than two others is dense."""
    def compute(x: np.ndarray) -> np.ndarray:
        if len(x) < 3:
            return np.full(len(x), -1e300)
        d, at = _nearest(x, k)
        v = np.where(np.isfinite(d) & (d > 0), x[at] - x[:, None], np.nan)
        i, j = np.triu_indices(v.shape[1], 1)
        c = 1 / (v[:, i] * v[:, j])
        n = (~np.isnan(c)).sum(1)
        mean, square = np.nansum(c, 1) / np.maximum(n, 1), np.nansum(c * c, 1) / np.maximum(n, 1)
        return np.where(n > 0, mean**2 - square, -1e300)

    return _by_block(df, key, k, compute)


def support_fractions(data: DataFrame, columns: Sequence[str], threshold: float = 0.01, least: float = 0.5) -> list[float]:
    """Five evenly spaced support fractions over standardised columns.

    The base is the share of columns whose sample deviation is not below ``threshold`` (two digits, ``least`` at least); the
    last is 0.4 above it, at most 0.99. One aggregate reads the table.
    """
    if not columns:
        base = least
    else:
        spread = data.agg(*[F.stddev_samp(c).alias(c) for c in columns]).first()
        low = sum(s is not None and s < threshold for s in spread)
        base = round(max(least, 1 - low / len(columns)), 2)
    return np.linspace(base, min(0.99, base + 0.4), 5).tolist()


def mcd(df: DataFrame, key: Sequence[str], support: float | None = None) -> DataFrame:
    """Squared distance to the window of h sorted values with the least variance."""
    n = df.count()
    h = max(2, math.ceil(n * support) if support else (n + 2) // 2)
    run = ordered.running_sum(
        df.select("x", *key), ["x", *key], {"s1": F.col("x"), "s2": F.col("x") * F.col("x"), "p": F.lit(1)})
    run = run.select("s1", "s2", F.col("p").cast("bigint").alias("p"))
    start = run.select((F.col("p") + h).alias("p"), F.col("s1").alias("b1"), F.col("s2").alias("b2"))
    start = start.unionByName(df.sparkSession.range(1).select(
        F.lit(h).cast("bigint").alias("p"), F.lit(0.0).alias("b1"), F.lit(0.0).alias("b2")))
    mean = (F.col("s1") - F.col("b1")) / h
    var = (F.col("s2") - F.col("b2")) / h - mean * mean
    best = run.join(start, "p").agg(F.min(F.struct(var.alias("v"), mean.alias("m")))).first()[0]
    return df.withColumn("score", F.pow(F.col("x") - best["m"], 2) / (best["v"] if best["v"] > 0 else 1.0))


def _moments(df: DataFrame) -> tuple[float, float]:
    mean, var = df.agg(F.avg("x"), F.var_pop("x")).first()
    return mean, var or 1.0


def pca(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Squared component score over its eigenvalue."""
    mean, var = _moments(df)
    return df.withColumn("score", F.pow(F.col("x") - mean, 2) / var)


def gmm(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Negative log-likelihood of one Gaussian, whose fit is the mean and variance."""
    mean, var = _moments(df)
    return df.withColumn("score", 0.5 * math.log(2 * math.pi * var) + F.pow(F.col("x") - mean, 2) / (2 * var))


def _kernel_shift(k: int) -> np.ndarray:
    """What turns the moments of a cell into the expansion about the centre of the cell ``k`` places before it."""
    u, orders = -k * KDE_CELL, range(2 * KDE_TERMS)
    he = [1.0, u]
    for n in orders:
        he.append(u * he[-1] - (n + 1) * he[-2])
    kernel = math.exp(-u * u / 2)
    return np.array([[(-1) ** m / math.factorial(m) * he[n + m] * kernel for n in range(KDE_TERMS)] for m in range(KDE_TERMS)])


def kde(df: DataFrame, key: Sequence[str], bandwidth: float = 1.0) -> DataFrame:
    """Minus the log of a Gaussian kernel density, by a fast Gauss sum.

    Cells of half a bandwidth keep the sums of powers of their rows' offsets; Hermite polynomials turn these into a power series
    about the centre of each occupied cell within ten bandwidths, in which every row reads its own place. With ``KDE_TERMS`` terms the sum of
    n kernels, at least 1 as a row's own counts, is off by less than n * 1e-15, plus n * 2e-22 for rows farther away.
    """
    place = F.col("x") / bandwidth
    cell = F.floor(place / KDE_CELL).cast("bigint")
    offset = place - (F.col("_c") + 0.5) * KDE_CELL
    rows = df.withColumn("_c", cell).withColumn("_s", offset)
    powers = [F.sum(F.pow("_s", F.lit(n)) / math.factorial(n)).alias(f"m{n}") for n in range(KDE_TERMS)]
    moments = cut_lineage(rows.groupBy("_c").agg(*powers))
    names = [f"l{m}" for m in range(KDE_TERMS)]

    def spread(batches):
        shifts = [(k, _kernel_shift(k)) for k in range(-KDE_REACH, KDE_REACH + 1)]
        for pdf in batches:
            held = pdf[[f"m{n}" for n in range(KDE_TERMS)]].to_numpy()
            for k, shift in shifts:
                yield pd.DataFrame(held @ shift.T, columns=names).assign(_c=pdf["_c"].to_numpy() - k)

    local = moments.mapInPandas(spread, f"{', '.join(f'{n} double' for n in names)}, _c long").groupBy("_c").agg(*[F.sum(n).alias(n) for n in names])
    local = cut_lineage(local.join(moments.select("_c"), "_c", "left_semi"))
    n, cells = moments.agg(F.sum("m0"), F.count(F.lit(1))).first()
    both = rows.join(F.broadcast(local) if cells <= KDE_SMALL else local, "_c")
    total = F.col(names[-1])
    for name in names[-2::-1]:
        total = total * F.col("_s") + F.col(name)
    return both.select(*df.columns, (-F.ln(total / ((n or 1.0) * bandwidth * math.sqrt(2 * math.pi)))).alias("score"))


def qmcd(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Mean wrap-around kernel 1.5 - d (1 - d) to all rows on [0, 1], turned round when its skew
    is negative. The sums over all rows come from running sums of x per distinct value."""
    lo, hi, n, s1, s2 = df.agg(
        F.min("x"), F.max("x"), F.count("x"), F.sum("x"), F.sum(F.col("x") * F.col("x"))).first()
    width = (hi - lo) or 1.0
    u = (F.col("x") - lo) / width
    t1, t2 = (s1 - n * lo) / width, (s2 - 2 * lo * s1 + n * lo * lo) / width**2
    counts = cut_lineage(df.groupBy("x").agg(F.count(F.lit(1)).alias("c")))
    run = ordered.running_sum(counts, ["x"], {"cn": F.col("c"), "cs": u * F.col("c")})
    near = u * F.col("cn") - F.col("cs") + (t1 - F.col("cs")) - u * (n - F.col("cn"))
    square = n * u * u - 2 * u * t1 + t2
    per = run.select("x", (1.5 - (near - square) / n).alias("score"))
    out = df.join(per, "x")
    lo_s, hi_s, skew = out.agg(F.min("score"), F.max("score"), F.skewness("score")).first()
    return out.withColumn("score", F.lit(hi_s + lo_s) - F.col("score")) if (skew or 0) < 0 else out


def sampling(df: DataFrame, key: Sequence[str], size: int = 20, seed: int = 42) -> DataFrame:
    """Distance to the nearest of a few rows picked by a digest of the key."""
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))
    rows = df.orderBy(digest, *key).limit(size).collect()
    points = F.array(*[F.lit(r["x"]) for r in rows])
    return df.withColumn("score", F.array_min(F.transform(points, lambda p: F.abs(F.col("x") - p))))


EXACT = {
    "MAD": mad, "HBOS": hbos, "ECOD": ecod, "COPOD": copod, "KNN": knn, "LOF": lof, "ABOD": abod, "MCD": mcd,
    "PCA": pca, "GMM": gmm, "KDE": kde, "QMCD": qmcd, "LODA": loda, "Sampling": sampling, "ROD": mad,
}
