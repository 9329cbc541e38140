"""Scalar helpers that Spark has no single function for."""

from __future__ import annotations

from collections.abc import Sequence

import re

from pyspark.sql import Column, functions as F


def where(test: Column, yes: Column, no: Column) -> Column:
    return F.when(test, yes).otherwise(no)


def floor_mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor; NULL for divisor 0."""
    return a - b * F.floor(F.try_divide(a, b))


def floor_divide(a: Column, b: Column) -> Column:
    return F.floor(F.try_divide(a, b))


def trunc(c: Column) -> Column:
    return F.signum(c) * F.floor(F.abs(c))


def gcd(a: Column, b: Column) -> Column:
    """Euclid's steps inside one expression; 93 steps are enough for any pair of longs."""
    start = F.struct(F.abs(a).cast("bigint").alias("x"), F.abs(b).cast("bigint").alias("y"))

    def step(s: Column, _: Column) -> Column:
        go = s["y"] != 0
        return F.struct(
            F.when(go, s["y"]).otherwise(s["x"]).alias("x"),
            F.when(go, F.expr("1L") * s["x"] % F.when(go, s["y"]).otherwise(F.lit(1))).otherwise(F.lit(0)).cast("bigint").alias("y"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, step, lambda s: s["x"])


def is_close(a: Column, b: Column, rel: float | Column = 1e-9, atol: float | Column = 0.0) -> Column:
    rel, atol = (x if isinstance(x, Column) else F.lit(x) for x in (rel, atol))
    return F.abs(a - b) <= F.greatest(rel * F.greatest(F.abs(a), F.abs(b)), atol)


def clip(c: Column, low: Column, high: Column) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def is_inf(c: Column) -> Column:
    return F.abs(c.cast("double")) == F.lit(float("inf"))


def is_finite(c: Column) -> Column:
    return ~(is_inf(c) | F.isnan(c.cast("double")))


def nan_to_num(c: Column) -> Column:
    c = F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))
    top = F.lit(1.7976931348623157e308)
    return F.least(F.greatest(c, -top), top)


def round_half_even(c: Column, digits: Column | int = 0) -> Column:
    return F.bround(c, digits)


def digitize(c: Column, edges: Sequence[float]) -> Column:
    """The number of ascending edges at or below the value."""
    out = F.lit(0)
    for e in edges:
        out = out + F.when(c >= F.lit(e), 1).otherwise(0)
    return F.when(c.isNotNull(), out)


def interp(c: Column, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Piecewise linear through (xs, ys), flat outside."""
    out = F.when(c <= F.lit(xs[0]), F.lit(float(ys[0])))
    for x0, x1, y0, y1 in zip(xs, xs[1:], ys, ys[1:]):
        out = out.when(c <= F.lit(x1), F.lit(float(y0)) + (c - F.lit(x0)) * F.lit((y1 - y0) / (x1 - x0)))
    return out.when(c.isNotNull(), F.lit(float(ys[-1])))


def linspace(start: float, stop: float, n: int) -> Column:
    """An array of n evenly spaced doubles."""
    gap = (stop - start) / max(1, n - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(float(start)) + i * F.lit(gap))


def cut(c: Column, edges: Sequence[float], labels: Sequence[str] | None = None) -> Column:
    """Right-closed bins over given edges; NULL outside."""
    out = None
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        value = F.lit(labels[i]) if labels else F.lit(i)
        test = (c > F.lit(a)) & (c <= F.lit(b))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def month_name(c: Column) -> Column:
    return F.date_format(c, "MMMM")


def day_name(c: Column) -> Column:
    return F.date_format(c, "EEEE")


def split(c: Column, pattern: str | None = None, n: int = -1, regex: bool | None = None) -> Column:
    """Pieces of a text at most ``n`` times parted: at white space runs, at a literal, or (longer than one character, or ``regex``) at a pattern."""
    limit = n + 1 if n > 0 else -1
    if pattern is None:
        return F.split(F.regexp_replace(c, r"^\s+" if n > 0 else r"^\s+|\s+$", ""), r"\s+", limit)
    return F.split(c, pattern if regex or (regex is None and len(pattern) > 1) else re.escape(pattern), limit)
