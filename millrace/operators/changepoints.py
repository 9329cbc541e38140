"""Change points by penalised optimal partitioning.

One task searches a series, whatever its length, in memory proportional to it. Series run side by
side; the time of one grows with the square of its length where few changes let starts be pruned.

Only where the caller gives ``block_rows`` are longer series cut into blocks, an approximation: each
block is searched together with the rows around it and keeps the changes among its own rows. For
the l2 cost the changes of all blocks are candidates of a second search over running sums.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from millrace import ordered
from millrace.session import cut_lineage

# Rows up to which a series is searched whole, by cost; a cost that is not named has no limit.
BLOCK_ROWS: dict[str, int] = {}
JUMP, MIN_POINTS = 5, 50
# Gaps sorted at once for the bandwidth, and rows whose kernel is added at once.
GAPS, KERNEL_ROWS = 1_000_000, 64


def middle_square(y: np.ndarray) -> float:
    """Median of the squared differences of all pairs, without holding the pairs."""
    y = np.sort(y)
    n, i = len(y), np.arange(len(y))
    ranks = ((n * (n - 1) // 2 - 1) // 2, n * (n - 1) // 4)
    # Row i's gaps y[j] - y[i] for first[i] <= j < last[i] lie in the bracket.
    first, last, low, high, mid = i + 1, np.full(n, n), 0.0, y[-1] - y[0], 0.0
    while (last - first).sum() > GAPS:
        at = np.clip(np.searchsorted(y, y + mid, "right"), first, last)
        below = (at - i - 1).sum()
        if below > ranks[1]:
            high, last = mid, at
        elif below <= ranks[0]:
            low, first = mid, at
        else:  # the bracket's middle falls between the two middle gaps
            some, more = at > i + 1, at < n
            return ((y[at[some] - 1] - y[some]).max() ** 2 + (y[at[more]] - y[more]).min() ** 2) / 2
        mid = (low + high) / 2
        if not low < mid < high:  # one value is left
            return high**2
    row = np.repeat(i, last - first)
    column = np.arange(len(row)) - np.repeat(np.cumsum(last - first) - last, last - first)
    gaps, before = np.sort(y[column] - y[row]), (first - i - 1).sum()
    return (gaps[ranks[0] - before] ** 2 + gaps[ranks[1] - before] ** 2) / 2


def segment_cost(y: np.ndarray, model: str) -> Callable[[np.ndarray, int], np.ndarray]:
    """``cost(starts, end)`` of the segments [start, end) for an array of starts."""
    if model == "l2":
        s1, s2 = (np.concatenate([[0.0], np.cumsum(v)]) for v in (y - y.mean(), (y - y.mean()) ** 2))
        return lambda a, b: (s2[b] - s2[a]) - (s1[b] - s1[a]) ** 2 / (b - a)
    if model == "l1":
        return lambda a, b: np.array([np.abs(y[i:b] - np.median(y[i:b])).sum() for i in a])
    if model == "rbf":
        mid = middle_square(y) or 1.0
        area, at = np.zeros(len(y) + 1), 0
        kernel = lambda a, b, c: np.exp(-np.clip((y[b:c, None] - y[a:c]) ** 2 / mid, 1e-2, 1e2))
        same = np.exp(-1e-2)

        def rbf(a: np.ndarray, b: int) -> np.ndarray:
            # area[s]: the kernel summed over all pairs of [s, at). Ends ascend, and so does the first start.
            nonlocal at
            low = int(a[0])
            while at < b:
                to = min(b, at + KERNEL_ROWS)
                k, first = kernel(min(low, at), at, to), min(low, at)
                new = k[:, at - first:]
                area[at:to] = new[::-1, ::-1].cumsum(0).cumsum(1).diagonal()[::-1]
                area[first:at] += 2 * k[:, :at - first].sum(0)[::-1].cumsum()[::-1] + new.sum()
                at = to
            return same * (b - a) - area[a] / (b - a)

        return rbf
    raise ValueError(f"unknown cost {model}")


def best_partition(places: Sequence[int], cost: Callable, penalty: float, min_size: int) -> list[int]:
    """Ends of the cheapest segments among ``places`` (ascending, from 0 to the length).

    A start that already costs more than the best total can never win later and is pruned.
    """
    places = np.asarray(places)
    total = {int(places[0]): 0.0}
    back: dict[int, int] = {}
    starts: list[int] = [int(places[0])]
    for end in map(int, places[1:]):
        ok = np.array([s for s in starts if end - s >= min_size], dtype=int)
        if not len(ok):
            continue
        costs = np.array([total[s] for s in ok]) + cost(ok, end)
        i = int(costs.argmin())
        total[end], back[end] = costs[i] + penalty, int(ok[i])
        dead = set(ok[costs > total[end]].tolist())
        starts = [s for s in starts if s not in dead] + [end]
    cuts, at = [], int(places[-1])
    while at in back:
        at = back[at]
        cuts.append(at)
    return sorted(c for c in cuts if c > places[0])


def change_points(df: DataFrame, value: str, order_by: Sequence[str], series: Sequence[str] = (), model: str = "l2",
                  min_segment_size: int = 10, penalty_factor: float = 2.0, max_change_points: int | None = None,
                  block_rows: int | None = None) -> DataFrame:
    """(series..., position): 0-based positions at which a new segment starts.

    The penalty is the series' standard deviation times the factor. A series of fewer than 50
    values gets none. With ``max_change_points``, of more than that many every n-th is reported.
    ``block_rows`` is the length up to which series are searched whole; without it all are.
    """
    data = df.where(F.col(value).isNotNull()).select(*series, *order_by, F.col(value).cast("double").alias("_y"))
    longest = ordered.largest_group(data, series)
    whole = block_rows or BLOCK_ROWS.get(model) or max(1, longest)
    size, around = whole // 2, whole // 4
    stats = data.groupBy(*series).agg(
        F.count("_y").alias("_n"), F.avg("_y").alias("_m"), (F.stddev_pop("_y") * penalty_factor).alias("_pen"))
    if longest <= whole:
        size, around = whole, 0
    blocks = ordered.blocked(data, order_by, around, around, series, rows=size)
    blocks = (blocks.join(F.broadcast(stats)) if not series else ordered.by_series(blocks, stats, series)).where(f"_n >= {MIN_POINTS}")
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in series)
    lead = kinds + ", " if kinds else ""

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ordered.POSITION)
        y, pen, start = pdf["_y"].to_numpy(), pdf["_pen"].iloc[0], int(pdf[ordered.POSITION].iloc[0])
        # Multiples of JUMP along the whole series, so that overlapping blocks agree on places.
        places = sorted({0, *range(-start % JUMP, len(y), JUMP), len(y)})
        cuts = best_partition(places, segment_cost(y, model), pen, min_segment_size) if len(y) >= 2 * min_segment_size else []
        mine = pdf[ordered.POSITION].to_numpy()[pdf[ordered.HOME].to_numpy(bool)]
        cuts = [start + c for c in cuts if len(mine) and mine[0] <= start + c <= mine[-1]]
        return _rows(pdf, series, cuts)

    by = [*series, ordered.BLOCK]
    found = blocks.select(*by, ordered.POSITION, ordered.HOME, "_y", "_pen").groupBy(*by).applyInPandas(search, f"{lead}position bigint")
    if model == "l2" and longest > whole:
        found = _merge(data, found, stats, order_by, series, lead, whole)
    if max_change_points is None:
        return found
    w = W.partitionBy(*series) if series else W.partitionBy(F.lit(0))
    ranked = found.withColumns({"_i": F.row_number().over(w.orderBy("position")) - 1, "_all": F.count(F.lit(1)).over(w)})
    step = F.greatest(F.lit(1), F.floor(F.col("_all") / max_change_points))
    thin = F.when(F.col("_all") > max_change_points, (F.col("_i") % step == 0) & (F.col("_i") / step < max_change_points)).otherwise(True)
    return ranked.where(thin).select(*series, "position")


def _rows(pdf: pd.DataFrame, series: Sequence[str], cuts: Sequence[int]) -> pd.DataFrame:
    """The cuts with the group's series values, also when there is no cut."""
    named = {c: pd.Series([pdf[c].iloc[0]] * len(cuts), dtype=object) for c in series}
    return pd.DataFrame({**named, "position": np.array(cuts, "int64")})


def _merge(data: DataFrame, found: DataFrame, stats: DataFrame, order_by, series, lead: str, whole: int) -> DataFrame:
    """Search again among the candidates of all blocks, on running sums at just those places."""
    many = stats.where(f"_n > {whole}")
    if many.isEmpty():
        return found
    mean = data.join(F.broadcast(stats)) if not series else ordered.by_series(data, stats, series)
    z = F.col("_y") - F.col("_m")
    run = ordered.running_sum(mean, order_by, {"s1": z, "s2": z * z, "position": F.lit(1)}, series)
    at = found.unionByName(stats.select(*series, F.col("_n").alias("position"))).distinct()
    sums = ordered.by_series(run.select(*series, F.col("position").cast("bigint").alias("position"), "s1", "s2", "_pen"), at, [*series, "position"])

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        pos = np.concatenate([[0], pdf["position"].to_numpy()])
        s1, s2 = (np.concatenate([[0.0], pdf[c].to_numpy()]) for c in ("s1", "s2"))
        cost = lambda a, b: (s2[b] - s2[a]) - (s1[b] - s1[a]) ** 2 / (pos[b] - pos[a])
        index = best_partition(range(len(pos)), cost, pdf["_pen"].iloc[0], 1)
        return _rows(pdf, series, pos[index])

    # One group is the candidates of a series, not its rows.
    grouped = sums.withColumn("_g", F.lit(0)).groupBy("_g", *series)
    return grouped.applyInPandas(search, f"{lead}position bigint")


def segments(df: DataFrame, value: str, order_by: Sequence[str], points: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """(series..., segment, start, end, mean, std, samples) between change points."""
    first = order_by[0]
    known = df.where(F.col(value).isNotNull()).select(*dict.fromkeys([*series, *order_by, value]))
    data = ordered.with_position(known, order_by, series, "_at").select(*dict.fromkeys([*series, first, value, "_at"]))
    marks = points.select(*series, F.col("position").alias("_at"), F.lit(1).alias("_new"))
    marked = cut_lineage(ordered.by_series(data, marks, [*series, "_at"], "left"))  # read for the sizes, the sums of blocks and the rows
    block = F.floor(F.col("_at") / ordered.part_rows(df))
    cut = ordered.running_sum(marked, ["_at"], {"_seg": F.coalesce("_new", F.lit(0))}, series, bucket=block)
    return cut.groupBy(*series, (F.col("_seg") + 1).cast("bigint").alias("segment")).agg(
        F.min(first).alias("start"), F.max(first).alias("end"), F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"), F.count(F.lit(1)).alias("samples"))
