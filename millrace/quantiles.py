"""Exact quantiles (linear interpolation, as pandas) that scale past one task.

Spark's own exact ``percentile`` merges every distinct value of a group into one
buffer. Two routes avoid that:

* ``column_quantiles``: whole columns. A bounded sketch gives a bracket of values around
  each wanted rank; rows are counted below, inside and above the brackets, and a bracket
  shrinks by another sketch until so few distinct values are left that they are picked
  exactly. Only counts are shuffled, never the column.
* ``group_quantiles``: one set per group. Equal values are counted first, then ranks come
  from running sums along the values, so a hot group is spread over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType, TimestampNTZType

from millrace.ordered import running_sum

ACCURACY = 2000
PICK_LIMIT = 50_000
MAX_ROUNDS = 12


def clean_double(c: str | Column) -> Column:
    """The column as double with NaN as NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def literal(value, kind: DataType) -> Column:
    """A collected value as a column of its type.

    A time without zone goes by its text: as a Python datetime it would be taken for an instant
    and shift with the session's zone.
    """
    text = isinstance(kind, TimestampNTZType) and value is not None
    return F.lit(str(value) if text else value).cast(kind)


def _num(x: float) -> str:
    """A double literal that keeps every digit."""
    return f"double('{x!r}')"


def _array(xs: Sequence[float]) -> str:
    return f"array({', '.join(f'{float(x)!r}D' for x in xs)})"


def _pick(counts: list[tuple[float, int]], below: int, rank: int) -> float:
    at = below
    for value, n in counts:
        at += n
        if rank < at:
            return value
    raise AssertionError("rank outside its bracket")


def column_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], method: str = "exact"
) -> dict[str, list[float | None]]:
    """``{column: [quantile per prob]}``, None for a column with no values."""
    probs = list(probs)
    if method == "approx":
        row = df.agg(*[
            F.percentile_approx(clean_double(c), probs, 10_000).alias(f"c{i}")
            for i, c in enumerate(columns)
        ]).first()
        return {c: list(row[i]) if row[i] else [None] * len(probs) for i, c in enumerate(columns)}

    data = df.select(*[clean_double(c).alias(f"c{i}") for i, c in enumerate(columns)])
    margin = 2.0 / ACCURACY
    spots = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-margin, margin)})
    cells = ", ".join(f"named_struct('k', {i}, 'v', c{i})" for i in range(len(columns)))
    first = {
        r["k"]: r for r in data.selectExpr(f"inline(array({cells}))").groupBy("k").agg(
            F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"),
            F.expr(f"percentile_approx(v, {_array(spots)}, {ACCURACY})").alias("s"),
        ).collect()
    }
    found: dict[tuple[int, float], float | None] = {}
    wanted: dict[tuple[int, float], dict] = {}
    for i in range(len(columns)):
        n = first[i]["n"] if i in first else 0
        for p in probs:
            if not n:
                found[i, p] = None
                continue
            h = (n - 1) * p
            h = round(h) if abs(h - round(h)) < 1e-9 * n ** 0.5 else h  # a rank, not a fraction
            at, ends = dict(zip(spots, first[i]["s"])), (first[i]["lo"], first[i]["hi"])
            wanted[i, p] = {
                "ranks": (math.floor(h), math.ceil(h)), "part": h - math.floor(h),
                "lo": ends[0] if p - margin <= 0 else at[p - margin],
                "hi": ends[1] if p + margin >= 1 else at[p + margin],
            }
    # What the brackets of a first pass hold; few enough values are picked in that same pass.
    held = sum(2 * margin * len(probs) * first[i]["n"] for i in first)
    for _ in range(MAX_ROUNDS):
        if not wanted:
            break
        spans = {i: _merged([(w["lo"], w["hi"]) for (j, _), w in wanted.items() if j == i])
                 for i in {k[0] for k in wanted}}
        parts = []
        for i, sp in spans.items():
            tests = " ".join(
                f"WHEN c{i} < {_num(lo)} THEN {2 * j} WHEN c{i} <= {_num(hi)} THEN {2 * j + 1}" for j, (lo, hi) in enumerate(sp))
            parts.append(f"named_struct('k', {i}, 'r', CASE {tests} ELSE {2 * len(sp)} END, 'v', c{i})")
        placed = data.selectExpr(f"inline(array({', '.join(parts)}))").where("v IS NOT NULL")
        inside = placed.where("r % 2 = 1")
        if held <= PICK_LIMIT:
            rows = placed.groupBy("k", "r", F.expr("IF(r % 2 = 1, v, NULL)").alias("v")).count().collect()
        else:
            rows = placed.groupBy("k", "r").count().collect()
        sizes: dict[tuple[int, int], int] = {}
        values: dict[tuple[int, int], list] = {}
        for r in rows:
            sizes[r["k"], r["r"]] = sizes.get((r["k"], r["r"]), 0) + r["count"]
            if held <= PICK_LIMIT and r["v"] is not None:
                values.setdefault((r["k"], r["r"]), []).append((r["v"], r["count"]))
        below = {
            (i, r): sum(sizes.get((i, q), 0) for q in range(r)) for i, sp in spans.items() for r in range(2 * len(sp) + 2)
        }
        big: dict[tuple[int, int], list] = {}
        for key, w in list(wanted.items()):
            i, sp = key[0], spans[key[0]]
            r0, r1 = (max(r for r in range(2 * len(sp) + 1) if below[i, r] <= rank) for rank in w["ranks"])
            if r0 != r1 or r0 % 2 == 0:  # the sketch missed: go on between the neighbouring brackets
                w["lo"] = sp[r0 // 2 - (1 if r0 % 2 == 0 else 0)][0] if r0 >= 2 or r0 % 2 else first[i]["lo"]
                w["hi"] = sp[r1 // 2][1] if r1 // 2 < len(sp) else first[i]["hi"]
            elif sp[r0 // 2][0] == sp[r0 // 2][1]:
                found[key] = sp[r0 // 2][0]
                del wanted[key]
            else:
                big.setdefault((i, r0), []).append(key)
        if held > PICK_LIMIT and big:
            hit = inside.where(" OR ".join(f"(k = {i} AND r = {r})" for i, r in big))
            few = {g: sizes[g] for g in big}
            if sum(few.values()) > PICK_LIMIT:
                grid = {(r["k"], r["r"]): r for r in hit.groupBy("k", "r").agg(
                    F.approx_count_distinct("v").alias("d"),
                    F.expr(f"percentile_approx(v, {_array([x / 200 for x in range(201)])}, {ACCURACY})").alias("s"),
                ).collect()}
                few = {g: grid[g]["d"] for g in big if grid[g]["d"] <= max(64, PICK_LIMIT // len(big))}
                for g in big.keys() - few.keys():
                    for key in big[g]:
                        w, lo, size = wanted[key], below[g], sizes[g]
                        q0, q1 = ((rank - lo) / size for rank in w["ranks"])
                        a, b = math.floor(q0 * 200) - 1, math.ceil(q1 * 200) + 1
                        w["lo"] = grid[g]["s"][a] if a >= 0 else spans[g[0]][g[1] // 2][0]
                        w["hi"] = grid[g]["s"][b] if b <= 200 else spans[g[0]][g[1] // 2][1]
            if few:
                small = hit.where(" OR ".join(f"(k = {i} AND r = {r})" for i, r in few))
                for r in small.groupBy("k", "r", "v").count().collect():
                    values.setdefault((r["k"], r["r"]), []).append((r["v"], r["count"]))
        for g, keys in big.items():
            if g in values:
                counts = sorted(values[g])
                for key in keys:
                    w = wanted.pop(key)
                    lo, hi = (_pick(counts, below[g], rank) for rank in w["ranks"])
                    found[key] = lo + (hi - lo) * w["part"]
    if wanted:
        raise RuntimeError("quantile brackets did not close")
    return {c: [found[i, p] for p in probs] for i, c in enumerate(columns)}


def _merged(spans: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Disjoint ascending intervals that cover the given ones."""
    out: list[list[float]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def group_quantiles(
    df: DataFrame, by: Sequence[str], column: str, probs: Sequence[float],
    names: Sequence[str] | None = None,
) -> DataFrame:
    """One row per group: ``by`` and a column per quantile (``q0``, ``q1``, ... by default)."""
    names = list(names or [f"q{i}" for i in range(len(probs))])
    counts = (
        df.select(*by, clean_double(column).alias("_v")).where("_v IS NOT NULL")
        .groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    )
    return count_quantiles(counts, by, "_v", "_n", probs, names)


def count_quantiles(
    counts: DataFrame, by: Sequence[str], value: str, n: str, probs: Sequence[float],
    names: Sequence[str],
) -> DataFrame:
    """``group_quantiles`` from a table that already holds (group, value, count)."""
    ranked = running_sum(counts, [value], {"_cum": F.col(n)}, by, totals={"_all": F.col(n)})
    aggs = []
    for i, p in enumerate(probs):
        h = (F.col("_all") - 1) * F.lit(float(p))
        for tag, rank in (("l", F.floor(h)), ("h", F.ceil(h))):
            here = (F.col("_cum") - F.col(n) <= rank) & (rank < F.col("_cum"))
            aggs.append(F.max(F.when(here, F.col(value))).alias(f"_{tag}{i}"))
        aggs.append(F.max(h - F.floor(h)).alias(f"_p{i}"))
    picked = ranked.groupBy(*by).agg(*aggs)
    return picked.select(*by, *[
        (F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.col(f"_p{i}")).alias(name)
        for i, name in enumerate(names)
    ])


def column_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """The most frequent value per column, the smallest among ties, in one job.

    Counts are combined map-side before the shuffle and one row per column reaches the
    driver.
    """
    best = None
    for i, c in enumerate(columns):
        one = (
            df.select(F.col(c).alias("v")).where("v IS NOT NULL").groupBy("v").count()
            .agg(F.min(F.struct((-F.col("count")).alias("n"), F.col("v"))).alias("m"))
            .select(F.lit(i).alias("i"), F.col("m.v").alias(f"v{i}"))
        )
        best = one if best is None else best.unionByName(one, allowMissingColumns=True)
    return {columns[r["i"]]: r[f"v{r['i']}"] for r in best.collect()}
