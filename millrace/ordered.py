"""Ordered work without one huge window partition.

``Window.orderBy`` with no partition, or with one hot partition, moves all its rows
to a single task. Here a total order over ``(series, order columns)`` is cut into
buckets by sampled edges, so a hot series is spread over several buckets, and what a
bucket must know about its neighbours travels in one of two ways:

* ``carry``: a summary row per (bucket, series), combined over the earlier (or later)
  buckets and joined back: running sums, last known values, row positions;
* ``framed``: rows near a block border are copied into the neighbour block, so that
  frames of fixed width (lag, lead, rolling) see every row they need.

Edges only decide where work happens, never what comes out.

Groups that a count has proven small (``SMALL_GROUP``) use the plain window.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from millrace.session import cut_lineage

BUCKET = "_mr_bucket"
POSITION = "_mr_pos"
BLOCK = "_mr_block"
HOME = "_mr_home"

ROWS_PER_BUCKET = 1_000_000
MAX_BUCKETS = 8192
SMALL_GROUP = 200_000
SAMPLE_PER_BUCKET = 40
_SEP, _SEP_RE = "\x01", "\\x01"


def _setting(df: DataFrame, name: str, default: int) -> int:
    return int(df.sparkSession.conf.get(f"millrace.{name}", str(default)))


def part_rows(df: DataFrame) -> int:
    """Rows of a bucket where the order itself tells them apart (a position, an even hash)."""
    return min(_setting(df, "rowsPerBucket", ROWS_PER_BUCKET), SMALL_GROUP)


def largest_group(df: DataFrame, series: Sequence[str]) -> int:
    """Rows of the largest series (of the table, when no series is named)."""
    if not series:
        return df.count()
    return df.groupBy(*series).count().agg(F.max("count")).first()[0] or 0


def is_small(df: DataFrame, series: Sequence[str]) -> bool:
    """True when a count proves that no series outgrows one task."""
    return largest_group(df, series) <= _setting(df, "smallGroup", SMALL_GROUP)


def _edges(df: DataFrame, order: Sequence[str], buckets: int, rows: int) -> Column | None:
    """Sorted bucket edges over ``order`` as one foldable array of structs."""
    wanted = buckets * SAMPLE_PER_BUCKET
    sample = df.select(*order).dropna()
    if rows > wanted:
        sample = sample.sample(fraction=min(1.0, wanted / rows), seed=17)
    # At most about SAMPLE_PER_BUCKET * MAX_BUCKETS short rows reach the driver.
    picked = sample.orderBy(*order).select(*[F.col(c).cast("string") for c in order]).collect()
    step = max(1, len(picked) // buckets)
    cuts, seen = [], set()
    for row in picked[step::step][: buckets - 1]:
        cut = tuple(row)
        if cut not in seen and not any(_SEP in part for part in cut):
            seen.add(cut)
            cuts.append(cut)
    if not cuts:
        return None
    types = [df.schema[c].dataType.simpleString() for c in order]
    parts = [
        F.split(F.lit(_SEP.join(cut[i] for cut in cuts)), _SEP_RE).cast(f"array<{t}>")
        for i, t in enumerate(types)
    ]
    fields = ",".join(f"k{i}:{t}" for i, t in enumerate(types))
    return F.arrays_zip(*parts).cast(f"array<struct<{fields}>>")


def with_bucket(df: DataFrame, order: Sequence[str], rows: int | None = None) -> DataFrame:
    """Add ``BUCKET``: ascending along ``order`` and about equal in size."""
    rows = df.count() if rows is None else rows
    per_bucket = _setting(df, "rowsPerBucket", ROWS_PER_BUCKET)
    spread = min(df.sparkSession.sparkContext.defaultParallelism, rows // 50_000)
    buckets = min(MAX_BUCKETS, max(math.ceil(rows / per_bucket), spread))
    edges = _edges(df, order, buckets, rows) if buckets > 1 else None
    if edges is None:
        return df.withColumn(BUCKET, F.lit(0))
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)])
    steps = [2**i for i in range(int(math.log2(buckets)) + 1, -1, -1)]

    # Binary search: the number of edges at or below the row's key.
    def advance(at: Column, step: Column) -> Column:
        passed = F.coalesce(F.get(edges, at + step - 1) <= key, F.lit(False))
        return F.when(passed, at + step).otherwise(at)

    return df.withColumn(
        BUCKET, F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), advance)
    )


def bucket_window(order: Sequence[str], series: Sequence[str] = ()) -> W:
    return W.partitionBy(BUCKET, *series).orderBy(*order)


def carry(
    bucketed: DataFrame,
    series: Sequence[str],
    summary: dict[str, tuple[Column, Callable[[str], Column]]],
    scope: str = "before",
) -> DataFrame:
    """Join to each row a combination of other buckets' summaries of its series.

    ``summary`` maps an output name to (aggregate per bucket, combiner over buckets);
    ``scope`` is ``before``, ``after`` or ``all``.
    """
    across = W.partitionBy(*series) if series else W.partitionBy(F.lit(0))
    if scope != "all":
        step = F.col(BUCKET) if scope == "before" else F.col(BUCKET).desc()
        across = across.orderBy(step).rowsBetween(W.unboundedPreceding, -1)
    keys = [BUCKET, *series]
    # Written once, its size is known and, where small, it is sent to the rows instead of these being dealt anew.
    per_bucket = cut_lineage(bucketed.groupBy(*keys).agg(*[a.alias(n) for n, (a, _) in summary.items()]))
    # Lead names out of the way so the join condition is unambiguous.
    side = per_bucket.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[combine(n).over(across).alias(n) for n, (_, combine) in summary.items()],
    )
    match = [bucketed[k].eqNullSafe(side[f"_r_{k}"]) for k in keys]
    return bucketed.join(side, match, "left").drop(*[f"_r_{k}" for k in keys])


def by_series(left: DataFrame, right: DataFrame, series: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on the series columns, a null series with a null one; ``right`` has one row per series."""
    others = [F.col(f"`{c}`") for c in right.columns if c not in series]
    side = right.select(*[F.col(f"`{c}`").alias(f"_r_{c}") for c in series], *others)
    match = [F.col(f"`{c}`").eqNullSafe(F.col(f"`_r_{c}`")) for c in series]
    return left.join(side, match, how).drop(*[f"_r_{c}" for c in series])


def running_sum(
    df: DataFrame, order: Sequence[str], sums: dict[str, Column], series: Sequence[str] = (),
    totals: dict[str, Column] | None = None, small: bool | None = None, bucket: Column | None = None,
) -> DataFrame:
    """Add inclusive running sums (and whole-series totals) along ``order``.

    Here and below ``small`` says what ``is_small`` would find out, where the caller knows it. ``bucket``, where given, ascends
    along the order in parts of bounded size, as a position over a number of rows does, and no edges are looked for.
    """
    totals = totals or {}
    if is_small(df, series) if small is None else small:
        w = W.partitionBy(*series) if series else W.partitionBy(F.lit(0))
        run = w.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return df.select(
            "*",
            *[F.sum(c).over(run).alias(n) for n, c in sums.items()],
            *[F.sum(c).over(w).alias(n) for n, c in totals.items()],
        )
    b = with_bucket(df, [*series, *order]) if bucket is None else df.withColumn(BUCKET, bucket)
    run = bucket_window(order, series).rowsBetween(W.unboundedPreceding, 0)
    for i, (n, c) in enumerate(sums.items()):
        b = b.withColumn(f"_term{i}", c)
    out = carry(b, series, {f"_off{i}": (F.sum(f"_term{i}"), F.sum) for i in range(len(sums))})
    if totals:
        out = carry(out, series, {n: (F.sum(c), F.sum) for n, c in totals.items()}, "all")
    out = out.select(
        *df.columns,
        *[
            (F.coalesce(F.col(f"_off{i}"), F.lit(0)) + F.sum(f"_term{i}").over(run)).alias(n)
            for i, n in enumerate(sums)
        ],
        *totals,
    )
    return out


def running_extreme(
    df: DataFrame, order: Sequence[str], highest: dict[str, str], lowest: dict[str, str], series: Sequence[str] = (),
    small: bool | None = None,
) -> DataFrame:
    """Add inclusive running maxima and minima (added column -> source column) along ``order``; nulls are passed over."""
    wanted = [(n, c, F.max, F.greatest) for n, c in highest.items()] + [(n, c, F.min, F.least) for n, c in lowest.items()]
    if is_small(df, series) if small is None else small:
        w = W.partitionBy(*series) if series else W.partitionBy(F.lit(0))
        run = w.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return df.select("*", *[extreme(c).over(run).alias(n) for n, c, extreme, _ in wanted])
    run = bucket_window(order, series).rowsBetween(W.unboundedPreceding, 0)
    out = carry(with_bucket(df, [*series, *order]), series, {f"_off{i}": (extreme(c), extreme) for i, (_, c, extreme, _) in enumerate(wanted)})
    return out.select(*df.columns, *[
        either(F.col(f"_off{i}"), extreme(c).over(run)).alias(n) for i, (n, c, extreme, either) in enumerate(wanted)])


def with_position(
    df: DataFrame, order: Sequence[str], series: Sequence[str] = (), name: str = POSITION,
    small: bool | None = None,
) -> DataFrame:
    """Add the 0-based row position inside each series along ``order``."""
    if is_small(df, series) if small is None else small:
        w = W.partitionBy(*series) if series else W.partitionBy(F.lit(0))
        return df.withColumn(name, F.row_number().over(w.orderBy(*order)).cast("bigint") - 1)
    b = carry(
        with_bucket(df, [*series, *order]), series, {"_off": (F.count(F.lit(1)), F.sum)}
    )
    here = F.row_number().over(bucket_window(order, series)) - 1
    return b.select(*df.columns, (F.coalesce("_off", F.lit(0)) + here).alias(name))


def fill_along(
    df: DataFrame, columns: Sequence[str], order: Sequence[str], series: Sequence[str] = (),
    forward: dict[str, str] | None = None, backward: dict[str, str] | None = None,
    small: bool | None = None,
) -> DataFrame:
    """Add last known values (``forward``) and next known values (``backward``).

    Both map a source column to the name of the added column; the row's own value counts.
    """
    forward, backward = forward or {}, backward or {}
    small = is_small(df, series) if small is None else small
    if small:
        w = (W.partitionBy(*series) if series else W.partitionBy(F.lit(0))).orderBy(*order)
        b = df
    else:
        b = with_bucket(df, [*series, *order])
        w = bucket_window(order, series)
        at = F.struct(*order)
        if forward:
            b = carry(b, series, {
                f"_f_{n}": (
                    F.max_by(c, F.when(F.col(c).isNotNull(), at)),
                    lambda s: F.last(s, ignorenulls=True),
                ) for c, n in forward.items()
            })
        if backward:
            b = carry(b, series, {
                f"_b_{n}": (
                    F.min_by(c, F.when(F.col(c).isNotNull(), at)),
                    lambda s: F.last(s, ignorenulls=True),
                ) for c, n in backward.items()
            }, "after")
    # A frame to the end of the partition costs a pass per row in Spark, so "next" is "last"
    # along the reversed order.
    keys = ([] if small else [BUCKET]) + list(series)
    back = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy(*[F.desc(c) for c in order])
    ahead, behind = (x.rowsBetween(W.unboundedPreceding, 0) for x in (w, back))
    added = []
    for c, n in forward.items():
        own = F.last(c, ignorenulls=True).over(ahead)
        added.append((own if small else F.coalesce(own, F.col(f"_f_{n}"))).alias(n))
    for c, n in backward.items():
        own = F.last(c, ignorenulls=True).over(behind)
        added.append((own if small else F.coalesce(own, F.col(f"_b_{n}"))).alias(n))
    return b.select(*df.columns, *added)


def framed(
    df: DataFrame, order: Sequence[str], build: Callable[[W], dict[str, Column]] | Sequence[Callable],
    before: int = 0, after: int = 0, series: Sequence[str] = (), position: str | None = None, small: bool | None = None,
) -> DataFrame:
    """Add window columns whose frames reach ``before`` rows back and ``after`` ahead.

    ``build`` gets the ordered window and returns the named columns; a list of builders runs
    one after the other, each on the columns of those before it, and ``before`` and ``after``
    are then the reach of all together. On large series the rows are numbered, cut into blocks
    of equal size, and each block also receives the few rows beyond its borders. ``position``
    names a column for the 0-based position in the series, which builders may use.
    """
    stages = [build] if callable(build) else list(build)
    if is_small(df, series) if small is None else small:
        w = (W.partitionBy(*series) if series else W.partitionBy(F.lit(0))).orderBy(*order)
        if position:
            df = with_position(df, order, series, position, small=True)
        for stage in stages:
            df = df.select("*", *[c.alias(n) for n, c in stage(w).items()])
        return df
    out = blocked(df, order, before, after, series, small=False)
    if position:
        out = out.withColumn(position, F.col(POSITION))
    w = W.partitionBy(*series, BLOCK).orderBy(POSITION)
    for stage in stages:
        out = out.select("*", *[c.alias(n) for n, c in stage(w).items()])
    return out.where(HOME).drop(HOME, BLOCK, POSITION)


def blocked(
    df: DataFrame, order: Sequence[str], before: int = 0, after: int = 0, series: Sequence[str] = (),
    rows: int | None = None, small: bool | None = None, position: str | None = None,
) -> DataFrame:
    """Rows with ``POSITION``, cut into blocks (``BLOCK``) of at most ``rows`` rows per series.

    Rows within ``before`` / ``after`` of a border also appear in the next / previous block,
    there with ``HOME`` false. A (series, block) group is bounded, so it may be one task's work.
    ``position`` names a column that already holds the 0-based position.
    """
    size = max(rows or _setting(df, "rowsPerBucket", ROWS_PER_BUCKET), before, after, 1)
    pos = with_position(df, order, series, small=small) if position is None else df.withColumn(POSITION, F.col(position))
    block = F.floor(F.col(POSITION) / size)
    inside = F.col(POSITION) % size
    away = lambda b: F.struct(b.alias("b"), F.lit(False).alias("h"))
    homes = F.array_compact(F.array(
        F.struct(block.alias("b"), F.lit(True).alias("h")),
        F.when(inside >= size - before, away(block + 1)),
        F.when((inside < after) & (block > 0), away(block - 1)),
    ))
    return pos.withColumn("_home", F.explode(homes)).select(
        *pos.columns, F.col("_home.b").alias(BLOCK), F.col("_home.h").alias(HOME)
    )
