"""Nearest neighbours over several columns as a join: exact, with gaps, in two rounds whatever the data.

Rows compare by the columns that both know. Every pair of (columns a donor knows, columns it shares with a row) is a space of its own;
in a space there are no gaps. Donors at one point are reduced to the ``k`` smallest keys, since ties go to the smaller key, and rows at
one point ask once, so repeated values cost nothing more.

Each space is cut into cells of about ``CELL`` points by a tree of axis splits fitted on a bounded sample of its points; every point
is then placed. In the first round a point asks its own cell, which bounds its k-th distance. In the second it asks all other cells
nearer than that bound. Nothing outside can be nearer, so the answer is exact. Questions meet a cell in groups of at most about
``GROUP``; the tree, two numbers a cell, is sent to every task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from millrace.session import cut_lineage

CELL, GROUP = 4096, 1000
#: Points per cell in the sample on which trees are fitted, and most points of it; cells grow in proportion beyond.
FIT_POINTS, FIT_MOST = 32, 400_000
MOST_COLUMNS, MOST_SPACES = 62, 10_000


def pattern(x: Column) -> Column:
    """The known places of an array as bits of a long."""
    bits = F.transform(x, lambda v, i: F.when(v.isNull(), F.lit(0)).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), i)).cast("long"))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def _shared(x: Column, mask: Column, width: int) -> Column:
    places = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1)) == 1)
    return F.transform(places, lambda i: F.get(x, i))


def split_tree(points: np.ndarray, cells: int) -> tuple[np.ndarray, ...]:
    """(dimension, border, left, right) of each split; children below 0 are cells -1, -2, ... Values up to the border go left."""
    dim, border, left, right = [], [], [], []
    made = 0
    todo = [(points, cells, -1, 0)]
    while todo:
        part, n, above, side = todo.pop()
        here = None
        if n > 1 and len(part) > 1:
            j = int(np.argmax(part.max(0) - part.min(0)))
            values = np.sort(part[:, j])
            cut = values[min(len(values) - 1, len(values) * (n // 2) // n)]
            if cut == values[-1]:  # something must go right
                below = values[values < cut]
                cut = below[-1] if len(below) else None
            if cut is not None:
                here = len(dim)
                dim.append(j), border.append(float(cut)), left.append(0), right.append(0)
                low = part[:, j] <= cut
                todo += [(part[~low], n - n // 2, here, 1), (part[low], n // 2, here, 0)]
        if here is None:
            made += 1
            here = -made
        if above >= 0:
            (right if side else left)[above] = here
    return np.array(dim, np.int64), np.array(border), np.array(left, np.int64), np.array(right, np.int64)


def cell_of(tree: tuple[np.ndarray, ...] | None, y: np.ndarray) -> np.ndarray:
    at = np.zeros(len(y), np.int64)
    if tree is None or not len(tree[0]):
        return at
    dim, border, left, right = tree
    open_ = np.arange(len(y))
    while len(open_):
        here = at[open_]
        low = y[open_, dim[here]] <= border[here]
        at[open_] = np.where(low, left[here], right[here])
        open_ = open_[at[open_] >= 0]
    return -1 - at


def cells_within(tree: tuple[np.ndarray, ...] | None, y: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of all cells whose squared distance from the row is at most its bound."""
    if tree is None or not len(tree[0]):
        return np.arange(len(y)), np.zeros(len(y), np.int64)
    dim, border, left, right = tree
    rows, cells = [], []
    todo = [(0, np.arange(len(y)), np.zeros_like(y))]
    while todo:
        here, at, away = todo.pop()
        if not len(at):
            continue
        if here < 0:
            rows.append(at)
            cells.append(np.full(len(at), -1 - here))
            continue
        j, gap = dim[here], y[at, dim[here]] - border[here]
        for child, out in ((left[here], np.maximum(gap, 0)), (right[here], np.maximum(-gap, 0))):
            off = away.copy()
            off[:, j] = np.maximum(off[:, j], out)
            near = (off**2).sum(1) <= bound[at] * (1 + 1e-12)
            todo.append((int(child), at[near], off[near]))
    return np.concatenate(rows), np.concatenate(cells)


def _by_space(batch: pa.RecordBatch):
    """(space, places in the batch, matrix of its points)."""
    spaces = batch["_s"].to_numpy()
    flat, ends = batch["_y"].flatten().to_numpy(), np.cumsum(pa.compute.list_value_length(batch["_y"]).to_numpy())
    for s in np.unique(spaces).tolist():
        at = np.flatnonzero(spaces == s)
        wide = int(ends[at[0]] - (ends[at[0] - 1] if at[0] else 0))
        yield s, at, flat[(ends[at] - wide)[:, None] + np.arange(wide)]


def _candidates(asked: np.ndarray, bound: np.ndarray, points: np.ndarray, copies: np.ndarray, k: int):
    """(place of the question, place of the point, squared distance) of all points up to the k-th donor, and that distance."""
    d = np.zeros((len(asked), len(points)))
    for j in range(asked.shape[1]):
        d += (asked[:, j, None] - points[:, j]) ** 2
    few = min(k, len(points))
    near = np.argpartition(d, few - 1, 1)[:, :few]
    dd = np.take_along_axis(d, near, 1)
    order = np.argsort(dd, 1, kind="stable")
    dd, held = np.take_along_axis(dd, order, 1), np.minimum(copies, k)[np.take_along_axis(near, order, 1)].cumsum(1)
    full = held >= k
    kth = np.where(full.any(1), dd[np.arange(len(dd)), full.argmax(1)], np.inf)
    limit = np.minimum(kth, bound)
    q, p = np.nonzero(d <= limit[:, None])
    return q, p, d[q, p], limit


def nearest(rows: DataFrame, donors: DataFrame, k: int, width: int, cell: int | None = None, group: int | None = None) -> DataFrame:
    """(_id, _g, _best): for every row its ``k`` nearest donors of the same group, as structs (_d, _key, _v) by squared distance and key.

    ``rows`` has _g (int), _id (any struct) and _x (``width`` numbers, gaps null); ``donors`` has _g, _key, _x and _v (any payload).
    Squared distances are scaled up by all / shared columns. A row that shares no column with any donor is left out.
    """
    if width > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} columns")
    spark, cell, group = rows.sparkSession, cell or CELL, group or GROUP
    rows, donors = (cut_lineage(d.withColumn("_p", pattern(F.col("_x")))) for d in (rows, donors))
    # Which columns are known: a few combinations of columns, whatever the number of rows.
    seen = [sorted(map(tuple, d.select("_g", "_p").distinct().limit(MOST_SPACES + 1).collect())) for d in (rows, donors)]
    spaces = {(g, p, p & q) for g, p in seen[1] for h, q in seen[0] if g == h and p & q}
    if len(spaces) > MOST_SPACES or max(map(len, seen)) > MOST_SPACES:
        raise ValueError("too many combinations of known columns")
    number = {s: i for i, s in enumerate(sorted(spaces))}
    kinds = "_g int, _p long, _s int, _m long"
    donor_side = spark.createDataFrame([(g, p, i, m) for (g, p, m), i in number.items()], kinds)
    row_side = spark.createDataFrame([(g, q, i, m) for (g, p, m), i in number.items() for h, q in seen[0] if g == h and p & q == m], kinds)
    y = _shared(F.col("_x"), F.col("_m"), width).alias("_y")
    placed = donors.join(F.broadcast(donor_side), ["_g", "_p"]).select("_s", y, "_key", "_v")
    first = F.row_number().over(W.partitionBy("_s", "_y").orderBy("_key"))
    points = cut_lineage(placed.withColumn("_n", first).where(F.col("_n") <= k).groupBy("_s", "_y").agg(
        F.array_sort(F.collect_list(F.struct("_key", "_v"))).alias("_near")))
    asking = cut_lineage(rows.join(F.broadcast(row_side), ["_g", "_p"]).select("_g", "_id", "_s", "_m", y))

    sizes = {r[0]: r[1] for r in points.groupBy("_s").count().collect()}
    share = min(1.0, FIT_POINTS / cell, FIT_MOST / max(1, sum(sizes.values())))
    draw = F.xxhash64("_y", F.lit(7)).bitwiseAND(F.lit((1 << 31) - 1)) <= F.lit(int(share * (1 << 31)))
    big = [s for s, n in sizes.items() if n > cell]
    drawn: dict[int, list] = {s: [] for s in big}
    for s, at in points.where(F.col("_s").isin(big) & draw).select("_s", "_y").collect() if big else []:
        drawn[s].append(at)
    trees = {s: split_tree(np.array(sorted(at), float), -(-sizes[s] // cell)) if at else None for s, at in drawn.items()}
    sent = spark.sparkContext.broadcast(trees)

    def place(batches):
        for batch in batches:
            cells = np.zeros(batch.num_rows, np.int64)
            for s, at, found in _by_space(batch):
                cells[at] = cell_of(sent.value.get(s), found)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], [*batch.schema.names, "_c"])

    def fields(df: DataFrame) -> str:
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    cells = cut_lineage(points.mapInArrow(place, f"{fields(points)}, _c long").groupBy("_s", "_c").agg(
        F.collect_list("_y").alias("_ys"), F.collect_list("_near").alias("_nears")))
    near_kind = points.schema["_near"].dataType.simpleString()

    def meet(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                s, mine = batch["_s"][i].as_py(), batch["_ask"][i].values
                asked = mine.field("_y").flatten().to_numpy().reshape(len(mine), -1)
                bound = mine.field("_b").to_numpy()
                ys, nears = batch["_ys"][i].values, batch["_nears"][i].values
                if ys is None or not len(ys):
                    q, p, d, limit = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), bound
                    nears = pa.array([], batch.schema.field("_nears").type.value_type)
                else:
                    wide = asked.shape[1]
                    q, p, d, limit = _candidates(asked, bound, ys.flatten().to_numpy().reshape(-1, wide), pa.compute.list_value_length(nears).to_numpy(), k)
                # The bound of each question, without donors, then its candidates.
                who = np.concatenate([np.arange(len(mine)), q])
                none = pa.nulls(len(mine), nears.type)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(who), s), pa.int32()), mine.field("_y").take(pa.array(who)), pa.array(np.concatenate([limit, d])),
                    pa.concat_arrays([none, nears.take(pa.array(p))])], ["_s", "_y", "_d", "_near"])

    def answered(questions: DataFrame, how: str) -> DataFrame:
        """Questions (_s, _c, _y, _b) put to their cells, in groups of bounded size."""
        many = questions.groupBy("_s", "_c").agg(F.ceil(F.count(F.lit(1)) / group).cast("long").alias("_parts"))
        part = F.pmod(F.xxhash64("_y"), F.col("_parts")).alias("_part")
        asked = questions.join(many, ["_s", "_c"]).select("_s", "_c", part, F.struct("_y", "_b").alias("_q")).groupBy("_s", "_c", "_part").agg(
            F.collect_list("_q").alias("_ask"))
        met = asked.join(cells, ["_s", "_c"], how).select("_s", "_ask", "_ys", "_nears")
        return met.mapInArrow(meet, f"_s int, _y array<double>, _d double, _near {near_kind}")

    asked_points = asking.select("_s", "_y").distinct()
    own = asked_points.mapInArrow(place, "_s int, _y array<double>, _c long").withColumn("_b", F.lit(float("inf")))
    one = cut_lineage(answered(own, "left"))

    def route(batches):
        for batch in batches:
            bound = batch["_d"].to_numpy()
            for s, at, found in _by_space(batch):
                tree = sent.value.get(s)
                rows_, visited = cells_within(tree, found, bound[at])
                other = visited != cell_of(tree, found)[rows_]
                at = at[rows_[other]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), s), pa.int32()), pa.array(visited[other]), batch["_y"].take(pa.array(at)), pa.array(bound[at])], ["_s", "_c", "_y", "_b"])

    found = one.where("_near IS NOT NULL")
    if big:
        visits = cut_lineage(one.where("_near IS NULL").select("_s", "_y", "_d").mapInArrow(route, "_s int, _c long, _y array<double>, _b double"))
        found = found.union(answered(visits, "inner").where("_near IS NOT NULL"))
    each = F.transform("_near", lambda s: F.struct(F.col("_d").alias("_d"), s["_key"].alias("_key"), s["_v"].alias("_v")))
    best = found.groupBy("_s", "_y").agg(F.slice(F.array_sort(F.flatten(F.collect_list(each))), 1, k).alias("_best"))
    scale = F.lit(float(width)) / F.bit_count("_m")
    mine = asking.join(best, ["_s", "_y"]).select("_g", "_id", F.transform("_best", lambda s: F.struct(
        (s["_d"] * scale).alias("_d"), s["_key"].alias("_key"), s["_v"].alias("_v"))).alias("_best"))
    if len(number) == len({g for g, _, _ in number}):  # one space for each group: nothing to merge
        return mine.select("_id", "_g", "_best")
    return mine.groupBy("_id", "_g").agg(F.slice(F.array_sort(F.flatten(F.collect_list("_best"))), 1, k).alias("_best"))


def others(df: DataFrame, key: Sequence[str], subsets: Sequence[Sequence[str]], k: int) -> DataFrame:
    """(_g, _id, _near): per subset of columns (by its number) and row the ``k`` nearest other rows, as structs (_d, _key).

    Distances are Euclidean over the subset; rows without a value in every column of the subset are left out.
    """
    columns = list(dict.fromkeys(c for s in subsets for c in s))
    base = df.select(F.struct(*[F.col(f"`{c}`") for c in key]).alias("_id"), *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    parts = F.array(*[F.struct(
        F.lit(g).alias("_g"), F.array(*[F.col(f"`{c}`") if c in s else F.lit(None).cast("double") for c in columns]).alias("_x"),
        F.lit(len(s)).alias("_n")) for g, s in enumerate(subsets)])
    wide = base.select("_id", F.explode(parts).alias("_e")).select("_e._g", "_id", "_e._x", "_e._n")
    wide = wide.where(F.size(F.filter("_x", lambda v: v.isNotNull())) == F.col("_n")).drop("_n")
    got = nearest(wide, wide.select("_g", F.col("_id").alias("_key"), "_x", F.lit(0).alias("_v")), k + 1, len(columns))
    sizes = F.create_map(*[x for g, s in enumerate(subsets) for x in (F.lit(g), F.lit(len(s) / len(columns)))])
    near = F.slice(F.filter("_best", lambda s: s["_key"] != F.col("_id")), 1, k)
    return got.select("_g", "_id", F.transform(near, lambda s: F.struct(
        F.sqrt(s["_d"] * F.element_at(sizes, F.col("_g"))).alias("_d"), s["_key"].alias("_key"))).alias("_near"))
