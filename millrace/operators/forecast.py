"""Forecasts with confidence bounds: moving average, naive, exponential smoothing."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from millrace import ordered
from millrace.session import cut_lineage

#: Weights from which the search starts, without and with trend or season.
LEVELS = tuple(round(0.02 * i, 2) for i in range(1, 50))
COARSE, SLOW = (0.05, 0.2, 0.5, 0.9), (0.02, 0.2)
#: First step of the search, without and with trend or season, the step at which it ends, most rounds; least and greatest weight.
SEARCH, SETTLED, ROUNDS, LEAST, MOST = {False: 0.01, True: 0.1}, 1e-3, 40, 1e-4, 1 - 1e-4
#: Rows that one task runs through.
BLOCK_ROWS = 50_000
#: Rows of a piece of a block (up to a whole number of periods), and how many numbers the maps of pieces run side by side may take.
PIECE_ROWS, PIECE_NUMBERS = 200, 500_000


def _split(df: DataFrame, value: str, order_by: Sequence[str], train_pct: float) -> tuple[DataFrame, int, int]:
    data = ordered.with_position(
        df.where(F.col(value).isNotNull()).select(*order_by, F.col(value).cast("double").alias("_y")), order_by, name="_at")
    n = data.count()
    return data, n, int(n * train_pct / 100)


def block_maps(y: np.ndarray, sets: np.ndarray, trend: bool, period: int, phase: int) -> np.ndarray:
    """What additive smoothing does to any state over these rows, for each set of weights: a row of numbers that ``composed`` reads.

    With u = (1, state before the rows), the state after them is M u, the sum of one-step errors t u and that of their squares u' G u, as
    every step is linear. So the rows are run once with no state, and once with each unit state and no values. Pieces of the rows (of
    whole periods) run side by side, and what they do is put together in order.
    """
    n, wide = len(sets), 2 + trend + period
    length = math.ceil(PIECE_ROWS / max(period, 1)) * max(period, 1)
    pieces = max(1, PIECE_NUMBERS // (n * wide * wide))
    whole, parts = len(y) // length * length, []
    if pieces > 1:
        for at in range(0, whole, length * pieces):
            parts.append(_one_after_another(_piece_maps(y[at:min(whole, at + length * pieces)].reshape(-1, length), sets, trend, period, phase)))
    else:
        whole = 0
    if whole < len(y) or not parts:
        parts.append(_piece_maps(y[None, whole:], sets, trend, period, phase))
    gram, total, state = _one_after_another(tuple(np.concatenate(p, axis=1) for p in zip(*parts)))
    return np.concatenate([gram.reshape(n, -1), total.reshape(n, -1), state.reshape(n, -1)], axis=1)


def _piece_maps(y: np.ndarray, sets: np.ndarray, trend: bool, period: int, phase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(G, t, M) by set and piece, for the pieces of equal length that are the rows of ``y`` and start at one phase."""
    n, many, wide = len(sets), len(y), 2 + trend + period
    alpha, beta, gamma = sets.T[:, :, None, None]
    level, slope, season = np.zeros((n, many, wide)), np.zeros((n, many, wide)), np.zeros((max(period, 1), n, many, wide))
    level[..., 1] = 1
    if trend:
        slope[..., 2] = 1
    for i in range(period):
        season[i, ..., 2 + trend + i] = 1
    gram, total = np.zeros((n, many, wide, wide)), np.zeros((n, many, wide))
    for t in range(y.shape[1]):
        k = (phase + t) % period if period else 0
        e = -(level + slope + season[k])
        e[..., 0] += y[:, t]
        gram += e[..., :, None] * e[..., None, :]
        total += e
        level = level + slope + alpha * e
        if trend:
            slope = slope + alpha * beta * e
        if period:
            season[k] += gamma * (1 - alpha) * e
    return gram, total, np.stack([level, *([slope] if trend else []), *season[:period]], axis=2)


def _one_after_another(maps: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(G, t, M) of all pieces in order, by joining neighbours until one is left."""
    gram, total, state = maps
    while gram.shape[1] > 1:
        even = gram.shape[1] // 2 * 2
        left, right = ((gram[:, i:even:2], total[:, i:even:2], state[:, i:even:2]) for i in (0, 1))
        into = np.concatenate([np.zeros_like(left[2][..., :1, :]), left[2]], axis=2)  # what the right piece takes over
        into[..., 0, 0] = 1
        joined = (left[0] + into.swapaxes(2, 3) @ right[0] @ into, left[1] + (right[1][..., None, :] @ into)[..., 0, :], right[2] @ into)
        gram, total, state = (np.concatenate([j, m[:, even:]], axis=1) for j, m in zip(joined, (gram, total, state)))
    return gram, total, state


def composed(maps: Sequence[np.ndarray], state: np.ndarray) -> tuple[float, float, np.ndarray]:
    """(sum of squared errors, sum of errors, final state) over blocks in order, from their maps and the first state."""
    wide, squares, errors = len(state) + 1, 0.0, 0.0
    for m in maps:
        u = np.append(1.0, state)
        squares += float(u @ m[:wide * wide].reshape(wide, wide) @ u)
        errors += float(m[wide * wide:wide * wide + wide] @ u)
        state = m[wide * wide + wide:].reshape(-1, wide) @ u
    return squares, errors, state


def first_state(first: Sequence[float], last: float, n: int, trend: bool, period: int) -> np.ndarray:
    """Level and seasons from the first period, slope from the ends of the series."""
    level = float(np.mean(first))
    season = [(v - level) for v in first[:period]] if period else []
    return np.array([level, *([(last - first[0]) / max(1, n - 1)] if trend else []), *season, *[0.0] * (period - len(season))])


def weights_around(centre: Sequence[float] | None, step: float, trend: bool, period: int) -> np.ndarray:
    """Sets of weights to try: the first ones, or those about a centre (which comes first)."""
    if centre is None:
        if not trend and not period:
            return np.array([(a, 0.0, 0.0) for a in LEVELS])
        return np.array(list(product(COARSE, SLOW if trend else (0.0,), SLOW if period else (0.0,))))
    moves = (0, -step, step) if trend or period else tuple(i * step / 4 for i in (0, -4, -3, -2, -1, 1, 2, 3, 4))
    parts = [[min(MOST, max(LEAST, c + m)) for m in moves] if used else [0.0] for c, used in zip(centre, (True, trend, period > 0))]
    return np.unique(np.array(list(product(*parts))), axis=0)


def fit_smoothing(train: DataFrame, series: Sequence[str], trend: bool = False, period: int = 0,
                  weights: Sequence[float] | None = None) -> DataFrame:
    """(series..., _weights, _state, _v, _step): per series the weights of least squared one-step error, the state after its last row and the
    variance of the errors. ``train`` has (series..., _at, _y) with positions from 0.

    Blocks return what they do to any state, so errors and states are exact at any length and for any cut into blocks. The search starts
    from a few sets of weights and moves to the best set a step away, or halves the step where there is none, until all steps are below
    ``SETTLED`` (or after ``ROUNDS``; ``_step`` tells); each round is one pass for all series. ``weights`` leaves the search out.
    """
    by = list(series) or ["_all"]
    if not series:
        train = train.withColumn("_all", F.lit(0))
    blocks = cut_lineage(ordered.blocked(train, ["_at"], series=by, rows=BLOCK_ROWS).select(*by, ordered.BLOCK, ordered.POSITION, "_y"))
    starts = cut_lineage(train.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_at") < max(period, 1), F.struct("_at", "_y")))), lambda r: r["_y"]).alias("_first"),
        F.max_by("_y", "_at").alias("_last"), F.count("_y").alias("_n")))
    kinds = ", ".join(f"`{c}` {train.schema[c].dataType.simpleString()}" for c in by)
    step = SEARCH[bool(trend or period)]

    def named(pdf: pd.DataFrame, n: int) -> dict:
        return {c: pd.Series([pdf[c].iloc[0]] * n, dtype=object) for c in by}

    given = None if weights is None else np.array([[*weights, 0.0, 0.0][:3]], float)

    def mapped(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ordered.POSITION)
        centre, size = (pdf["_weights"].iloc[0], pdf["_step"].iloc[0]) if "_weights" in pdf else (None, 2 * step)
        sets = given if given is not None else weights_around(centre, size, trend, period)
        maps = block_maps(pdf["_y"].to_numpy(), sets, trend, period, int(pdf[ordered.POSITION].iloc[0]) % period if period else 0)
        return pd.DataFrame({**named(pdf, len(sets)), "_b": pdf[ordered.BLOCK].iloc[0], "_w": [list(map(float, s)) for s in sets], "_m": list(maps),
                             "_centre": [[] if centre is None else list(map(float, centre))] * len(sets), "_size": float(size)})

    def chosen(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        state, n, found = first_state(list(first["_first"]), first["_last"], int(first["_n"]), trend, period), int(first["_n"]), []
        for w, part in pdf.assign(_w=pdf["_w"].map(tuple)).groupby("_w", sort=True):
            squares, errors, last = composed(list(part.sort_values("_b")["_m"]), state)
            found.append((squares, w, errors, last))
        squares, w, errors, last = min(found, key=lambda f: f[:2])
        stays = not len(first["_centre"]) or tuple(first["_centre"]) == w
        return pd.DataFrame({**named(pdf, 1), "_weights": [list(w)], "_state": [list(map(float, last))], "_v": [max(0.0, squares / n - (errors / n) ** 2)],
                             "_step": [first["_size"] / 2 if stays else first["_size"]]})

    best = None
    for _ in range(1 if weights is not None else ROUNDS):
        source = blocks if best is None else ordered.by_series(blocks, best.select(*by, "_weights", "_step"), by)
        maps = source.groupBy(*by, ordered.BLOCK).applyInPandas(
            mapped, f"{kinds}, _b long, _w array<double>, _m array<double>, _centre array<double>, _size double")
        # A group here is one row for each block and set of weights of a series.
        best = cut_lineage(ordered.by_series(maps, starts, by).groupBy(*by).applyInPandas(
            chosen, f"{kinds}, _weights array<double>, _state array<double>, _v double, _step double"))
        if (best.agg(F.max("_step")).first()[0] or 0) < SETTLED:
            break
    return best.drop("_all")


def forecast(df: DataFrame, value: str, order_by: Sequence[str], steps: int = 10, method: str = "exponential_smoothing",
             train_pct: float = 80, confidence: float = 95, window: int = 5, trend: bool = False,
             period: int = 0, weights: Sequence[float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(step, forecast, lower, upper) and one row (ci, mae, rmse) against the rows after the
    training part, when there are ``steps`` of them. Smoothing weights (level, slope, season) are fitted unless given."""
    data, n, size = _split(df, value, order_by, train_pct)
    train = data.where(F.col("_at") < size)
    last = [r["_y"] for r in train.where(F.col("_at") >= size - max(window, 10)).orderBy("_at").collect()]  # a few rows
    spread = lambda ys: float(np.std(ys, ddof=1)) if len(ys) > 1 else math.nan
    if method == "moving_average":
        values, std = [float(np.mean(last[-window:]))] * steps, spread(last[-window:])
    elif method == "naive":
        values, std = [last[-1]] * steps, spread(last[-10:])
    elif method == "exponential_smoothing":
        period = 0 if period > size // 2 else period
        fitted = fit_smoothing(train.select("_at", "_y"), [], trend, period, weights).first()
        level, *rest = fitted["_state"]
        slope, season = (rest[0] if trend else 0.0), rest[int(trend):]
        values = [level + h * slope + (season[(size + h - 1) % period] if period else 0.0) for h in range(1, steps + 1)]
        std = math.sqrt(fitted["_v"])
    else:
        raise ValueError(f"unknown method {method}")
    ci = NormalDist().inv_cdf(1 - (100 - confidence) / 200) * std
    spark = df.sparkSession
    table = spark.createDataFrame(
        [(h + 1, float(v), float(v - ci), float(v + ci)) for h, v in enumerate(values)], "step int, forecast double, lower double, upper double")
    test = data.where((F.col("_at") >= size) & (F.col("_at") < size + steps)).withColumn("step", (F.col("_at") - size + 1).cast("int"))
    gap = F.col("_y") - F.col("forecast")
    enough = F.count(F.lit(1)) == steps
    scores = test.join(table, "step").agg(
        F.when(enough, F.avg(F.abs(gap))).alias("mae"), F.when(enough, F.sqrt(F.avg(gap * gap))).alias("rmse"))
    return table, scores.withColumn("ci", F.lit(float(ci)))
