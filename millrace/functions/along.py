"""User expressions that look along an order.

``x.shift(n)``, ``.diff(n)``, ``.pct_change(n)``, ``.cumsum()``, ``.cummax()``, ``.cummin()``, ``.ffill()``, ``.bfill()``,
``.rolling(n).mean()`` (sum, min, max, std, count), ``.expanding().mean()`` (sum, min, max, count) and ``.rank()`` inside any
expression, each within its series. The order must be total: rows that tie in it have no defined neighbour. Missing values are
skipped as in a data frame library: a running sum is null on the row itself and goes on behind it.

Every level of nesting takes one pass for all its frames, one for its running sums, one for its extremes and one for its fills, by
buckets of the order, so that no series has to fit into one task. Ranks number the distinct values and are joined back.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from millrace import ordered
from millrace.functions.expressions import _Builder, _parsed, along_call
from millrace.session import cut_lineage

ROLLING = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp, "count": F.count}
RANKS = ("average", "min", "max", "dense")


@dataclass
class _Passes:
    """What one level of nesting needs; ``out`` names the columns that its calls become."""

    before: int = 0
    after: int = 0
    frames: dict[str, Callable] = field(default_factory=dict)
    sums: dict[str, Column] = field(default_factory=dict)
    highest: dict[str, str] = field(default_factory=dict)
    lowest: dict[str, str] = field(default_factory=dict)
    forward: dict[str, str] = field(default_factory=dict)
    backward: dict[str, str] = field(default_factory=dict)
    ranks: dict[str, list[tuple]] = field(default_factory=dict)
    finish: dict[str, Column] = field(default_factory=dict)

    def _frame(self, out: str, before: int, after: int, column: Callable) -> None:
        self.before, self.after = max(self.before, before), max(self.after, after)
        self.frames[out] = column

    def _shifted(self, out: str, x: str, periods: int, finish: Callable = lambda value: value) -> None:
        step = (lambda w: F.lag(x, periods).over(w)) if periods >= 0 else (lambda w: F.lead(x, -periods).over(w))
        self._frame(out, max(periods, 0), max(-periods, 0), lambda w: finish(step(w)))

    def shift(self, out, x, periods=1, fill_value=None):
        if fill_value is None:
            return self._shifted(out, x, periods)
        step = (lambda w: F.lag(F.struct(x), periods).over(w)) if periods >= 0 else (lambda w: F.lead(F.struct(x), -periods).over(w))
        # Only rows beyond the end are filled, not missing values.
        self._frame(out, max(periods, 0), max(-periods, 0), lambda w: F.when(step(w).isNull(), F.lit(fill_value)).otherwise(step(w)[x]))

    def diff(self, out, x, periods=1):
        self._shifted(out, x, periods, lambda value: F.col(x) - value)

    def pct_change(self, out, x, periods=1):
        self._shifted(out, x, periods, lambda value: F.try_divide(F.col(x), value) - 1)

    def rolling(self, out, x, stat, window, min_periods=None, center=False):
        if window < 1:
            raise ValueError("a window has at least one row")
        after = (window - 1) // 2 if center else 0
        before = window - 1 - after
        least = window if min_periods is None else min_periods
        held = F.count(F.lit(1) if stat == "count" else x)  # a count asks for rows, the others for values
        rows = lambda w: w.rowsBetween(-before, after)
        self._frame(out, before, after, lambda w: F.when(held.over(rows(w)) >= least, ROLLING[stat](x).over(rows(w))))

    def _running(self, out: str, x: str) -> tuple[Column, Column]:
        self.sums |= {f"{out}_s": F.coalesce(x, F.lit(0)), f"{out}_n": F.col(x).isNotNull().cast("bigint")}
        return F.col(f"{out}_s"), F.col(f"{out}_n")

    def expanding(self, out, x, stat, min_periods=1):
        total, n = self._running(out, x)
        held, value = n, {"sum": total, "mean": total / n, "count": n}.get(stat)
        if stat in ("min", "max"):
            (self.highest if stat == "max" else self.lowest)[f"{out}_e"] = x
            value = F.col(f"{out}_e")
        elif stat == "count":
            self.sums[f"{out}_r"] = F.lit(1)
            held = F.col(f"{out}_r")
        self.finish[out] = F.when(held >= (min_periods if stat == "count" else max(min_periods, 1)), value)

    def cumsum(self, out, x):
        total, _ = self._running(out, x)
        self.finish[out] = F.when(F.col(x).isNotNull(), total)

    def cummax(self, out, x):
        self.highest[f"{out}_e"] = x
        self.finish[out] = F.when(F.col(x).isNotNull(), F.col(f"{out}_e"))

    def cummin(self, out, x):
        self.lowest[f"{out}_e"] = x
        self.finish[out] = F.when(F.col(x).isNotNull(), F.col(f"{out}_e"))

    def ffill(self, out, x):
        self.finish[out] = F.col(self.forward.setdefault(x, f"{out}_f"))

    def bfill(self, out, x):
        self.finish[out] = F.col(self.backward.setdefault(x, f"{out}_f"))

    def rank(self, out, x, method="average", ascending=True, pct=False):
        if method not in RANKS:
            raise ValueError(f"rank method {method}: one of {', '.join(RANKS)} is expected")
        self.ranks.setdefault(x, []).append((out, method, ascending, pct))

    def run(self, df: DataFrame, order: Sequence[str], series: Sequence[str], small: bool) -> DataFrame:
        # A pass over a large table reads it several times (rows, edges, buckets), so what it reads is written first.
        settled = (lambda d: d) if small else cut_lineage
        for x, asked in self.ranks.items():
            df = ordered.by_series(df, _ranks(df, x, series, asked, small), [*series, x], "left")
        if self.sums:
            df = ordered.running_sum(settled(df), order, self.sums, series, small=small)
        if self.highest or self.lowest:
            df = ordered.running_extreme(settled(df), order, self.highest, self.lowest, series, small=small)
        if self.forward or self.backward:
            df = ordered.fill_along(settled(df), [], order, series, self.forward, self.backward, small=small)
        if self.frames:
            df = ordered.framed(settled(df), order, lambda w: {n: c(w) for n, c in self.frames.items()}, self.before, self.after, series, small=small)
        return df.withColumns(self.finish) if self.finish else df


def _ranks(df: DataFrame, x: str, series: Sequence[str], asked: Sequence[tuple], small: bool) -> DataFrame:
    """(series..., x, ranks...): one row per distinct value, however many rows share it."""
    copies, upto, place, rows, kinds = (F.col(f"_along_{n}") for n in ("copies", "upto", "place", "rows", "kinds"))
    values = df.where(F.col(x).isNotNull()).groupBy(*series, x).agg(F.count(F.lit(1)).alias("_along_copies"))
    values = values if small else cut_lineage(values)
    run = ordered.running_sum(values, [x], {"_along_upto": copies, "_along_place": F.lit(1)}, series, {"_along_rows": copies, "_along_kinds": F.lit(1)},
                              small=True if small else None)
    out = []
    for name, method, ascending, pct in asked:
        first = upto - copies + 1 if ascending else rows - upto + 1
        last = first + copies - 1
        rank = {"min": first, "max": last, "average": (first + last) / 2, "dense": place if ascending else kinds - place + 1}[method].cast("double")
        out.append((rank / (kinds if method == "dense" else rows) if pct else rank).alias(name))
    return run.select(*series, x, *out)


def ordered_exprs(df: DataFrame, texts: Sequence[str], order_by: Sequence[str], series: Sequence[str] = ()) -> tuple[DataFrame, list[Column]]:
    """The table with helper columns (``_along...``) and each text as a column over it; texts share their passes."""
    tree, quoted = _parsed("".join(f"({t})," for t in texts))
    if not isinstance(tree, ast.Tuple) or len(tree.elts) != len(texts):
        raise ValueError(f"not expressions: {texts}")
    taken, small = 0, None
    while True:
        builder = _Builder(df, quoted)
        calls = [n for n in ast.walk(tree) if along_call(builder, n)]
        inner = [n for n in calls if not any(m is not n and m in calls for m in ast.walk(n))]
        if not inner:
            return df, [builder.build(e) for e in builder.settled(tree).elts]
        small = ordered.is_small(df, series) if small is None else small
        columns = builder.settled(ast.Tuple(elts=[along_call(builder, n)[1] for n in inner])).elts
        passes, values, put, names = _Passes(), {}, {}, {}
        for n, value in zip(inner, columns):
            name, _, given, (args, keywords) = along_call(builder, n)
            while any(c.startswith(f"_along{taken}_") for c in df.columns):
                taken += 1
            # Calls on the same values read one column.
            x = names.setdefault(ast.dump(value), f"_along{taken}_x")
            out = f"_along{taken}_y"
            taken += 1
            values[x], put[id(n)] = builder.build(value), ast.Name(id=out)
            try:
                getattr(passes, name)(out, x, *given, *map(ast.literal_eval, args), **{k.arg: ast.literal_eval(k.value) for k in keywords})
            except TypeError as e:
                raise ValueError(f"wrong arguments: {ast.unparse(n)}") from e
        df = df.withColumns(values)
        kinds = dict(df.dtypes)
        floats = [x for x in values if kinds[x] in ("double", "float")]
        df = df.withColumns({x: F.nanvl(x, F.lit(None).cast("double")) for x in floats}) if floats else df

        class Put(ast.NodeTransformer):
            def visit(self, n):
                return put[id(n)] if id(n) in put else self.generic_visit(n)

        df, tree = passes.run(df, list(order_by), list(series), small), Put().visit(tree)
