"""Detectors whose model is fitted on a bounded, seeded sample.

Isolation trees and nearest-neighbour spheres (whose small subsamples are the method itself) are step functions of a column and
become a lookup column; the others are scored in Arrow batches and are approximations for tables larger than their sample.

The sample is the rows with the smallest key hash, so it does not depend on partitioning; the
fitted arrays are small and travel with the tasks. Inputs are 2-D arrays (rows x columns).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from millrace.session import hash_sample

SEED = 42


def take_sample(df: DataFrame, columns: Sequence[str], key: Sequence[str], size: int, seed: int = SEED) -> np.ndarray:
    rows = hash_sample(df.select(*columns, *key), key, size, seed).toPandas()
    return rows[list(columns)].to_numpy(float)


def with_score(df: DataFrame, columns: Sequence[str], score: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    @F.pandas_udf(DoubleType())
    def run(part: pd.DataFrame) -> pd.Series:
        return pd.Series(score(part.to_numpy(float)))

    return df.withColumn("score", run(F.struct(*columns)))


def _distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances, one column at a time to keep memory at rows x points."""
    return np.sqrt(sum((x[:, j, None] - points[:, j]) ** 2 for j in range(x.shape[1])))


def step_score(x: Column, breaks: np.ndarray, score: Callable[[np.ndarray], np.ndarray]) -> Column:
    """A score that changes only at ``breaks``, as a lookup by binary search inside the row.

    Every break and the number after it are edges, so that what holds exactly at a break is kept.
    """
    breaks = np.unique(breaks)
    edges = np.unique(np.concatenate([breaks, np.nextafter(breaks, np.inf)])) if len(breaks) else np.zeros(1)
    values = score(np.concatenate([[edges[0] - 1], edges])[:, None])
    table = lambda xs: F.split(F.lit(",".join(map(repr, map(float, xs)))), ",").cast("array<double>")
    held, found = table(edges), table(values)
    steps = [2**i for i in range(len(edges).bit_length() - 1, -1, -1)]

    def advance(at: Column, step: Column) -> Column:
        return F.when(F.coalesce(F.get(held, at + step - 1) <= x, F.lit(False)), at + step).otherwise(at)

    return F.get(found, F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), advance))


def isolation_forest(points: np.ndarray, trees: int = 100, size: int = 256, seed: int = SEED):
    """Random splits isolate outliers early: score 2 ** (-mean depth / expected depth)."""
    rng = np.random.default_rng(seed)
    size = min(size, len(points))
    limit = int(np.ceil(np.log2(max(size, 2))))
    expected = lambda n: 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def grow(part: np.ndarray, depth: int):
        spread = np.flatnonzero(part.max(0) > part.min(0)) if len(part) else []
        if depth >= limit or len(part) < 2 or not len(spread):
            return depth + expected(len(part))
        j = rng.choice(spread)
        cut = rng.uniform(part[:, j].min(), part[:, j].max())
        cuts.append(cut)
        low = part[:, j] < cut
        return j, cut, grow(part[low], depth + 1), grow(part[~low], depth + 1)

    cuts: list[float] = []
    forest = [grow(points[rng.choice(len(points), size, replace=False)], 0) for _ in range(trees)]

    def depth_of(node, x: np.ndarray, out: np.ndarray, rows: np.ndarray) -> None:
        if not isinstance(node, tuple):
            out[rows] += node
            return
        low = x[rows, node[0]] < node[1]
        depth_of(node[2], x, out, rows[low])
        depth_of(node[3], x, out, rows[~low])

    def score(x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for tree in forest:
            depth_of(tree, x, total, np.arange(len(x)))
        return 2 ** (-(total / len(forest)) / max(expected(size), 1e-12))

    score.breaks = np.array(cuts)
    return score


def inne(points: np.ndarray, rounds: int = 200, size: int = 8, seed: int = SEED):
    """Smallest sampled sphere that holds the row, compared with its nearest neighbour's sphere."""
    rng = np.random.default_rng(seed)
    size = min(size, len(points))
    balls = []
    for _ in range(rounds):
        c = points[rng.choice(len(points), size, replace=False)]
        d = _distances(c, c)
        np.fill_diagonal(d, np.inf)
        near = d.argmin(1)
        r = d.min(1)
        balls.append((c, r, 1 - (r[near] + 1e-12) / (r + 1e-12)))

    def score(x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for c, r, s in balls:
            d = _distances(x, c)
            radius = np.where(d <= r, r, np.inf)
            best = radius.argmin(1)
            total += np.where(np.isfinite(radius.min(1)), s[best], 1.0)
        return total / len(balls)

    if points.shape[1] == 1:
        score.breaks = np.concatenate([np.concatenate([c[:, 0] - r, c[:, 0] + r]) for c, r, _ in balls])
    return score


def ocsvm(points: np.ndarray, nu: float = 0.5, seed: int = SEED):
    """RBF one-class machine: pairwise updates of the dual until no pair violates by 1e-4."""
    n = len(points)
    gamma = 1.0 / (points.shape[1] * (points.var() or 1.0))
    kernel = lambda x: np.exp(-gamma * _distances(x, points) ** 2)
    k, top = kernel(points), 1.0 / (nu * n)
    alpha = np.full(n, 1.0 / n)
    grad = k @ alpha
    for _ in range(20 * n):
        up, down = np.where(alpha < top - 1e-12, grad, np.inf), np.where(alpha > 1e-12, grad, -np.inf)
        i, j = up.argmin(), down.argmax()
        if down[j] - up[i] < 1e-4:
            break
        move = min((grad[j] - grad[i]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12), top - alpha[i], alpha[j])
        alpha[i] += move
        alpha[j] -= move
        grad += move * (k[i] - k[j])
    free = (alpha > 1e-9) & (alpha < top - 1e-9)
    rho = grad[free].mean() if free.any() else grad.mean()
    return lambda x: rho - kernel(x) @ alpha


def dif(points: np.ndarray, networks: int = 10, width: int = 20, seed: int = SEED):
    """Isolation forests on the outputs of fixed random networks, averaged."""
    rng = np.random.default_rng(seed)
    parts = []
    for i in range(networks):
        w1, b1 = rng.normal(size=(points.shape[1], width)), rng.normal(size=width)
        w2 = rng.normal(size=(width, width)) / np.sqrt(width)
        net = lambda x, w1=w1, b1=b1, w2=w2: np.tanh(np.tanh(x @ w1 + b1) @ w2)
        parts.append((net, isolation_forest(net(points), 10, 256, seed + i)))
    return lambda x: sum(f(net(x)) for net, f in parts) / len(parts)


def kpca(points: np.ndarray, components: int = 10, seed: int = SEED):
    """What an RBF kernel PCA of the sample leaves unexplained of the row."""
    gamma = 1.0 / points.shape[1]
    kernel = lambda x: np.exp(-gamma * _distances(x, points) ** 2)
    k = kernel(points)
    col, whole = k.mean(0), k.mean()
    values, vectors = np.linalg.eigh(k - col - col[:, None] + whole)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    keep = values > 0.01 * k.trace()  # a lone sampled outlier must not explain itself
    load = vectors[:, keep] / np.sqrt(values[keep])

    def score(x: np.ndarray) -> np.ndarray:
        kx = kernel(x)
        own = 1 - 2 * kx.mean(1) + whole
        z = (kx - col - kx.mean(1, keepdims=True) + whole) @ load
        return np.sqrt(np.maximum(own - (z**2).sum(1), 0))

    return score


# model -> (fit, sample size)
SAMPLED = {
    "IForest": (isolation_forest, 25_600), "INNE": (inne, 1600), "OCSVM": (ocsvm, 500),
    "DIF": (dif, 2560), "KPCA": (kpca, 300),
}


def score_sampled(df: DataFrame, columns: Sequence[str], key: Sequence[str], model: str) -> DataFrame:
    fit, size = SAMPLED[model]
    score = fit(take_sample(df, columns, key, size))
    if len(columns) == 1 and hasattr(score, "breaks"):
        return df.withColumn("score", step_score(F.col(columns[0]), score.breaks, score))
    return with_score(df, columns, score)
