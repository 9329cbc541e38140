"""ARIMA by conditional least squares over blocks.

With errors before the first row taken as 0, an error is its value less the constant, the weighted values before it and the weighted errors
before it; its derivatives by the parameters follow recursions of the same shape. Both are linear in the few numbers that a block
takes over from the one before, so a block returns the sums of products of errors and derivatives as a quadratic form in these numbers, and
what it does to them. Blocks of a series are then put together in order: sums and states are exact at any length and for any cut.
Rows are numbered and packed into blocks once; every step of the fit (Gauss-Newton, several dampings at once) is one pass over the packed blocks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from millrace import ordered
from millrace.session import cut_lineage

BLOCK_ROWS = 50_000
#: Most steps of the fit, the relative gain at which it ends, and the dampings that each step tries at once.
STEPS, GAIN, DAMPINGS = 25, 1e-9, (0.0, 1e-2, 1.0, 1e2, 1e4)


def _differenced(y: np.ndarray, d: int) -> np.ndarray:
    w = np.full(len(y), np.nan)
    w[d:] = np.diff(y, d) if d else y
    return w


def recursed(x: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """v with v_t = x_t - theta_1 v_{t-1} - .. - theta_q v_{t-q} along each row of ``x``, from 0.

    Pieces of the rows run side by side from 0; what a piece takes over from the one before is added as responses to a unit before it.
    """
    many, rows = x.shape
    q = len(theta)
    length = max(q, math.ceil(math.sqrt(rows)))
    pieces = max(1, -(-rows // length))
    v = np.zeros((many + q, pieces, q + length))  # the last q rows respond to a unit in one of the q places before the first
    v[:many].reshape(many, pieces, -1)[:, :, q:] = np.pad(x, ((0, 0), (0, pieces * length - rows))).reshape(many, pieces, length)
    for j in range(q):
        v[many + j, :, q - 1 - j] = 1.0
    for t in range(q, q + length):
        for j in range(q):
            v[:, :, t] -= theta[j] * v[:, :, t - 1 - j]
    own, unit = v[:many, :, q:], v[many:, 0, q:]
    before = np.zeros((many, q))  # the values 1 .. q places before a piece
    for i in range(pieces):
        if before.any():
            own[:, i] += before @ unit
        before = own[:, i, ::-1][:, :q]
    return own.reshape(many, -1)[:, :rows]


def responses(rows: int, theta: np.ndarray) -> np.ndarray:
    """By place 1 .. q before the first row: what the recursion makes of a unit there, over the rows."""
    q = len(theta)
    x = np.zeros((q, rows))
    for j in range(q):  # the unit j + 1 places before row 0 enters row t by the weight of lag t + j + 1
        for t in range(min(rows, q - j)):
            x[j, t] = -theta[t + j]
    return recursed(x, theta)


def block_map(y: np.ndarray, pos: np.ndarray, home: np.ndarray, beta: np.ndarray, p: int, d: int, q: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(G, M, n): with u = (1, state before), sums of products are u' G u by pairs of quantities and the state after is M u; n errors.

    Quantities are the error and its derivatives by the constant, the ``p`` and the ``q`` weights; the state is the last ``q`` of each.
    Every quantity is one given by the values plus responses to the state, which are few: products are summed over these alone.
    """
    w = _differenced(y, d)
    at = np.flatnonzero(home & (pos >= p + d))
    kinds, wide, n = 2 + p + q, 1 + q * (2 + p + q), len(at)
    lags = np.stack([w[at - i] for i in range(1, p + 1)], 1) if p else np.zeros((n, 0))
    given = np.zeros((n, kinds))  # what each quantity gets from the values alone
    given[:, 0] = w[at] - beta[0] - lags @ beta[1:1 + p]
    given[:, 1] = -1.0
    given[:, 2:2 + p] = -lags
    if not q:
        return (given.T @ given).reshape(kinds, 1, kinds, 1), np.zeros((0, 1)), n
    theta = beta[1 + p:]
    plain, unit = recursed(given[:, :2 + p].T, theta), responses(n, theta)

    def later(e: np.ndarray, start: np.ndarray) -> np.ndarray:
        """For each weight the values of ``e`` as many places before, with ``start`` (1 .. q places before row 0) before them."""
        line = np.concatenate([start[::-1], e])
        return np.stack([line[q - 1 - i:q - 1 - i + n] for i in range(q)])

    by_weight = recursed(-later(plain[0], np.zeros(q)), theta)
    mixed = [recursed(-later(unit[j], np.eye(q)[j]), theta) for j in range(q)]
    basis = np.concatenate([plain, by_weight, unit, *mixed])
    pick = np.zeros((kinds, wide, len(basis)))  # what of the basis each quantity takes by each number of u
    first = np.zeros((q, kinds, wide))
    for a in range(kinds):
        pick[a, 0, a] = 1.0
        for j in range(q):
            pick[a, 1 + j * kinds + a, kinds + j] = first[j, a, 1 + j * kinds + a] = 1.0
            if a >= 2 + p:
                pick[a, 1 + j * kinds, kinds + q + j * q + a - 2 - p] = 1.0
    flat = pick.reshape(-1, len(basis))
    gram = flat @ (basis @ basis.T) @ flat.T
    state = [(flat @ basis[:, n - 1 - j]).reshape(kinds, wide) if j < n else first[j - n] for j in range(q)]
    return gram.reshape(kinds, wide, kinds, wide), np.concatenate(state), n


def put_together(maps: Sequence[tuple[np.ndarray, np.ndarray]], kinds: int, q: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sums of products over blocks in order, and the state before each block."""
    state, total, before = np.zeros(q * kinds), np.zeros((kinds, kinds)), []
    for gram, move in maps:
        u = np.append(1.0, state)
        before.append(state)
        total += np.einsum("aibj,i,j->ab", gram, u, u)
        state = move @ u if q else state
    return total, before


def moved(best: np.ndarray, sse: float, tried: np.ndarray, sums: np.ndarray, p: int) -> tuple[np.ndarray, float, np.ndarray, bool]:
    """(best parameters, their squared errors, what to try next, whether the fit has settled), from the sums of what was tried.

    ``sse`` is NaN before the first step, which leaves the weights of errors at 0, as there are no errors of a fit yet.
    """
    first = bool(np.isnan(sse))
    errors = np.where(np.isfinite(sums).all(axis=(1, 2)), sums[:, 0, 0], np.inf)
    i = int(errors.argmin())
    if not first and not errors[i] < sse * (1 - GAIN):
        return best, sse, tried[:0], True
    slope, curve = sums[i][1:, 0], sums[i][1:, 1:]
    free = np.arange(len(slope)) < (1 + p if first else len(slope))
    steps = np.zeros((len(DAMPINGS), len(slope)))
    for k, damping in enumerate(DAMPINGS):
        damped = curve + np.diag(np.diag(curve) * damping)
        steps[k, free] = np.linalg.lstsq(damped[np.ix_(free, free)], -slope[free], rcond=None)[0]
    return tried[i], float(errors[i]), tried[i] + steps, False


def fitted_errors(df: DataFrame, value: str, order_by: Sequence[str], p: int, d: int, q: int, series: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows with their position ``_at`` among the known values, errors (series..., _at, _e), fits (series..., _best, _sse)).

    The first p + d values of a series have no error.
    """
    by = list(series) or ["_all"]
    known = df.where(F.col(value).isNotNull())
    if not series:
        known = known.withColumn("_all", F.lit(0))
    placed = cut_lineage(ordered.with_position(known, order_by, by, "_at"))
    block, reach = F.floor(F.col("_at") / BLOCK_ROWS), p + d
    inside = F.col("_at") % BLOCK_ROWS
    homes = F.array_compact(F.array(block, F.when((inside >= BLOCK_ROWS - reach) & F.lit(reach > 0), block + 1)))
    rows = placed.select(*by, "_at", F.col(value).cast("double").alias("_y"), F.explode(homes).alias("_b"))
    packed = cut_lineage(rows.groupBy(*by, "_b").agg(F.array_sort(F.collect_list(F.struct("_at", "_y"))).alias("_rows")).select(
        *by, "_b", F.transform("_rows", lambda r: r["_at"]).alias("_p"), F.transform("_rows", lambda r: r["_y"]).alias("_y")))
    packed = packed.where(F.element_at("_p", -1) >= F.col("_b") * BLOCK_ROWS)  # a block of rows before the border alone is none
    kinds, count = ", ".join(f"`{c}` {placed.schema[c].dataType.simpleString()}" for c in by), 2 + p + q

    def arrays(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pos = np.asarray(row["_p"], np.int64)
        return np.asarray(row["_y"], float), pos, pos >= row["_b"] * BLOCK_ROWS

    def mapped(batches):
        for pdf in batches:
            out = []
            for _, row in pdf.iterrows():
                here = arrays(row)
                for i, beta in enumerate(np.asarray(row["_tried"], float).reshape(-1, 1 + p + q)):
                    with np.errstate(all="ignore"):  # a step too far may overflow; it is then not taken
                        gram, move, n = block_map(*here, beta, p, d, q)
                    out.append((*[row[c] for c in by], row["_b"], i, gram.ravel(), move.ravel(), n))
            yield pd.DataFrame(out, columns=[*by, "_b", "_i", "_g", "_m", "_n"])

    def opened(pdf: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
        wide = 1 + q * count
        return [(np.asarray(g).reshape(count, wide, count, wide), np.asarray(m).reshape(-1, wide)) for g, m in zip(pdf["_g"], pdf["_m"])]

    def stepped(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, row = pdf.sort_values(["_i", "_b"]), pdf.iloc[0]
        with np.errstate(all="ignore"):
            sums = np.stack([put_together(opened(part), count, q)[0] for _, part in pdf.groupby("_i", sort=True)])
        tried = np.asarray(row["_tried"], float).reshape(-1, 1 + p + q)
        best, sse, tried, done = moved(np.asarray(row["_best"], float), row["_sse"], tried, sums, p)
        if pdf.loc[pdf["_i"] == 0, "_n"].sum() <= 1 + p + q:
            sse, done = float("nan"), True
        return pd.DataFrame({**{c: pd.Series([row[c]], dtype=object) for c in by}, "_tried": [list(tried.ravel())], "_best": [list(best)],
                             "_sse": [sse], "_done": [done]})

    fit_kinds = f"{kinds}, _tried array<double>, _best array<double>, _sse double, _done boolean"
    zeros = F.array_repeat(F.lit(0.0), 1 + p + q)
    fits = packed.select(*by).distinct().select(*by, zeros.alias("_tried"), zeros.alias("_best"), F.lit(float("nan")).alias("_sse"), F.lit(False).alias("_done"))
    maps_kind = f"{kinds}, _b long, _i int, _g array<double>, _m array<double>, _n long"
    for _ in range(STEPS):
        open_ = fits.where(~F.col("_done"))
        maps = ordered.by_series(packed, open_.select(*by, "_tried"), by).mapInPandas(mapped, maps_kind)
        made = ordered.by_series(maps, open_, by).groupBy(*by).applyInPandas(stepped, fit_kinds)  # a row for each block and step
        fits = cut_lineage(made.unionByName(fits.where("_done")))
        if not fits.where(~F.col("_done")).limit(1).count():
            break
    final = cut_lineage(fits.select(*by, F.col("_best").alias("_tried"), "_sse"))

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_b")
        _, before = put_together(opened(pdf), count, q)
        return pdf[[*by, "_b"]].assign(_start=[list(map(float, s)) for s in before])

    maps = ordered.by_series(packed, final, by).where(~F.isnan("_sse")).drop("_sse").mapInPandas(mapped, maps_kind)
    begun = maps.groupBy(*by).applyInPandas(starts, f"{kinds}, _b long, _start array<double>")

    def errors(batches):
        for pdf in batches:
            for _, row in pdf.iterrows():
                y, pos, home = arrays(row)
                beta, w = np.asarray(row["_tried"], float), _differenced(y, d)
                at = np.flatnonzero(home & (pos >= p + d))
                e = w[at] - beta[0] - (np.stack([w[at - i] for i in range(1, p + 1)], 1) @ beta[1:1 + p] if p else 0.0)
                if q:
                    theta, last = beta[1 + p:], np.asarray(row["_start"], float).reshape(q, count)[:, 0]
                    e = recursed(e[None], theta)[0] + last @ responses(len(e), theta)
                yield pd.DataFrame({**{c: pd.Series([row[c]] * len(at), dtype=object) for c in by}, "_at": pos[at], "_e": e})

    ready = ordered.by_series(ordered.by_series(packed, begun, [*by, "_b"]), final.select(*by, "_tried"), by)
    return placed, ready.mapInPandas(errors, f"{kinds}, _at long, _e double"), final.select(*by, F.col("_tried").alias("_best"), "_sse")
