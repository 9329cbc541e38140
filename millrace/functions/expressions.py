"""User expressions as Spark columns.

Python's own parser reads the text; every node becomes a Column, so the result is planned and compiled by Spark and nothing is
evaluated in Python. Division by zero gives NULL and ``%`` takes the sign of the divisor.

Filters may use ``& | ~`` as well as ``and or not`` (they bind alike), ``in``, ``not in``, back-quoted names, ``x if c else y``,
``.str`` and ``.dt`` methods (``s.str.split(',').str[0]`` gives a piece), ``get_dummies(x)['level']``. Whole-column aggregates (``mean(x)``, ``x.std()``, ``percentile(x, 50)``) are computed first, all of one
nesting level by one ``agg``, and enter as constants; they need a table, not just column names. What looks along an order
(``x.shift(1)``, ``x.cumsum()``, ``x.rank()``) is in ``along``.
"""

from __future__ import annotations

import ast
import math
import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions import scalars as S


def _sum_of(*values):
    return reduce(lambda a, b: a + b, values[0] if len(values) == 1 and isinstance(values[0], list) else values)


def _select(tests: list, values: list, default=0) -> Column:
    out = F.when(tests[0], values[0])
    for test, value in zip(tests[1:], values[1:]):
        out = out.when(test, value)
    return out.otherwise(default)


def _timedelta(days=0, seconds=0, minutes=0, hours=0, weeks=0) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.make_dt_interval(lit(days) + 7 * lit(weeks), lit(hours), lit(minutes), lit(seconds))


def _plain(values) -> list:
    """Constants of a list that must not hold columns."""
    if not isinstance(values, list) or any(isinstance(v, Column) for v in values):
        raise ValueError("a list of constants is expected")
    return values


# Names an expression may call.
FUNCTIONS: dict[str, Callable] = {
    "abs": F.abs, "fabs": F.abs, "sqrt": F.sqrt, "log": F.ln, "log10": F.log10, "log2": F.log2,
    "log1p": F.log1p, "exp": F.exp, "expm1": F.expm1, "sin": F.sin, "cos": F.cos, "tan": F.tan,
    "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh,
    "tanh": F.tanh, "degrees": F.degrees, "radians": F.radians, "ceil": F.ceil,
    "floor": F.floor, "factorial": F.factorial, "sign": F.signum, "isnan": F.isnan,
    "trunc": S.trunc, "gcd": S.gcd, "isclose": S.is_close, "clip": S.clip, "where": S.where,
    "isinf": S.is_inf, "isfinite": S.is_finite, "nan_to_num": S.nan_to_num, "pow": F.pow,
    "round": lambda c, digits=0: S.round_half_even(c, digits), "min": F.least, "max": F.greatest, "len": F.length,
    "int": lambda c: c.cast("bigint"), "float": lambda c: c.cast("double"),
    "str": lambda c: c.cast("string"), "bool": lambda c: c.cast("boolean"),
    "upper": F.upper, "lower": F.lower, "sum": _sum_of, "sorted": lambda values: F.array_sort(F.array(*values)),
    "divmod": lambda a, b: F.array(S.floor_divide(a, b).cast("double"), S.floor_mod(a, b).cast("double")),
    "digitize": lambda c, edges: S.digitize(c, _plain(edges)), "interp": lambda c, xs, ys: S.interp(c, _plain(xs), _plain(ys)),
    "select": _select, "cut": lambda c, bins, labels=None: S.cut(c, _plain(bins), labels),
    "linspace": S.linspace, "arange": lambda *a: F.sequence(*[F.lit(x) for x in ((0, a[0] - 1) if len(a) == 1 else (a[0], a[1] - 1))]),
    "zeros": lambda n: F.array_repeat(F.lit(0.0), n), "ones": lambda n: F.array_repeat(F.lit(1.0), n),
    "array": lambda values: F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]),
    "to_datetime": lambda c, format=None: F.try_to_timestamp(c.cast("string"), *([F.lit(format)] if format else [])),
    "to_numeric": lambda c, errors="coerce": c.cast("string").try_cast("double"),
    "date_range": lambda start, end: F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end))),
    "timedelta": _timedelta, "sub": lambda pattern, put, c: F.regexp_replace(c, pattern, put),
    "search": lambda pattern, c: c.rlike(pattern), "match": lambda pattern, c: c.rlike(f"^(?:{pattern})"),
}
#: Whole-column aggregates: a call with one column (two for the last ones).
AGGREGATES: dict[str, Callable] = {
    "mean": F.avg, "nanmean": F.avg, "std": F.stddev_pop, "nanstd": F.stddev_pop, "var": F.var_pop, "nanvar": F.var_pop, "sum": F.sum,
    "min": F.min, "max": F.max, "count": F.count, "nunique": F.countDistinct, "corrcoef": F.corr, "cov": F.covar_samp,
}
#: As methods: samples, as in a data frame library, where the functions above take the whole population.
METHOD_AGGREGATES = AGGREGATES | {"std": F.stddev_samp, "var": F.var_samp, "corr": F.corr, "skew": F.skewness}
TWO_COLUMNS = frozenset(("corrcoef", "cov", "corr"))
QUANTILES = frozenset(("median", "percentile", "quantile", "qcut"))
CONSTANTS = {"pi": math.pi, "e": math.e, "tau": math.tau, "inf": math.inf, "nan": math.nan, "Inf": math.inf, "NaN": math.nan}
MODULES = frozenset("np numpy pd pandas math statistics re datetime".split())

METHODS: dict[str, Callable] = {
    "isnull": lambda c: c.isNull(), "isna": lambda c: c.isNull(), "notnull": lambda c: c.isNotNull(), "notna": lambda c: c.isNotNull(),
    "fillna": lambda c, v: F.coalesce(c, v if isinstance(v, Column) else F.lit(v)), "isin": lambda c, values: c.isin(values),
    "between": lambda c, a, b: c.between(a, b), "astype": lambda c, kind: c.cast({"int": "bigint", "float": "double", "str": "string", "bool": "boolean"}.get(kind, kind)),
    "abs": F.abs, "round": lambda c, digits=0: S.round_half_even(c, digits),
    "clip": lambda c, a, b: S.clip(c, *[x if isinstance(x, Column) else F.lit(x) for x in (a, b)]),
}
TEXT_METHODS: dict[str, Callable] = {
    "contains": lambda c, p, case=True, regex=True: c.rlike(("" if case else "(?i)") + (p if regex else re.escape(p))),
    "startswith": lambda c, p: c.startswith(p), "endswith": lambda c, p: c.endswith(p), "lower": F.lower, "upper": F.upper,
    "strip": F.trim, "lstrip": F.ltrim, "rstrip": F.rtrim, "len": F.length, "title": F.initcap,
    "match": lambda c, p: c.rlike(f"^(?:{p})"), "fullmatch": lambda c, p: c.rlike(f"^(?:{p})$"), "extract": lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit("")),
    "replace": lambda c, a, b, regex=False: F.regexp_replace(c, a, b) if regex else F.replace(c, F.lit(a), F.lit(b)),
    "split": S.split, "get": lambda c, i: F.get(c, F.lit(i)) if i >= 0 else F.try_element_at(c, F.lit(i)),
    "isdigit": lambda c: c.rlike(r"^\d+$"), "zfill": lambda c, n: F.lpad(c, n, "0"), "slice": lambda c, a, b: F.substring(c, a + 1, b - a),
}
TIME_PARTS: dict[str, Callable] = {
    "year": F.year, "month": F.month, "day": F.day, "hour": F.hour, "minute": F.minute, "second": F.second, "quarter": F.quarter,
    "dayofyear": F.dayofyear, "dayofweek": F.weekday, "weekday": F.weekday, "week": F.weekofyear, "date": F.to_date,
    "month_name": S.month_name, "day_name": S.day_name,
}

#: Methods that look along an order, and those whose own methods do.
ALONG = frozenset("shift diff pct_change cumsum cummax cummin ffill bfill rank".split())
ALONG_WINDOWS = {"rolling": frozenset("mean sum min max std count".split()), "expanding": frozenset("mean sum min max count".split())}

_BINARY = {
    ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b,
    ast.Div: F.try_divide, ast.Mod: S.floor_mod, ast.Pow: F.pow, ast.FloorDiv: S.floor_divide,
}
_COMPARE = {
    ast.Gt: lambda a, b: a > b, ast.Lt: lambda a, b: a < b, ast.GtE: lambda a, b: a >= b,
    ast.LtE: lambda a, b: a <= b, ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b,
}
_BOOL = {ast.And: lambda a, b: a & b, ast.Or: lambda a, b: a | b}
_UNARY = {ast.USub: lambda a: -a, ast.UAdd: lambda a: a, ast.Not: lambda a: ~a}
_LEXEME = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|[&|~]""")


def simple_name(name: str) -> str:
    """The spelling of a column inside an expression: spaces to ``_``, no parentheses."""
    return re.sub(r"[()]", "", name).replace(" ", "_")


def _parsed(text: str) -> tuple[ast.expr, dict[str, str]]:
    """The syntax tree and the back-quoted names that stand-ins in it mean."""
    quoted: dict[str, str] = {}

    def plain(found: re.Match) -> str:
        piece = found.group()
        if piece[0] == "`":
            name = f"_quoted_{len(quoted)}"
            quoted[name] = piece[1:-1]
            return name
        return {"&": " and ", "|": " or ", "~": " not "}.get(piece, piece)

    try:
        return ast.parse(_LEXEME.sub(plain, text).strip(), mode="eval").body, quoted
    except SyntaxError as e:
        raise ValueError(f"not an expression: {text}") from e


class _Builder:
    """Columns of the nodes of one expression."""

    def __init__(self, columns: Sequence[str] | DataFrame, quoted: dict[str, str]):
        self.table = columns if isinstance(columns, DataFrame) else None
        listed = self.table.columns if self.table is not None else columns
        self.names = {simple_name(c): c for c in listed} | {c: c for c in listed}
        for stand_in, name in quoted.items():
            if name not in self.names:
                raise ValueError(f"unknown name in expression: {name}")
            self.names[stand_in] = self.names[name]

    def is_column(self, node: ast.AST) -> bool:
        """Whether the node varies by row."""
        return any(isinstance(n, ast.Name) and (n.id in self.names or n.id == "df") for n in ast.walk(node))

    def aggregate(self, node: ast.AST) -> tuple[str, list[ast.expr], bool] | None:
        """(name, arguments, as a method) if the node is an aggregate over whole columns."""
        match node:
            case ast.Call(func=ast.Name(id=name), args=args) | ast.Call(func=ast.Attribute(value=ast.Name(id="np" | "numpy" | "statistics" | "pd" | "pandas"), attr=name), args=args):
                method = False
            case ast.Call(func=ast.Attribute(value=value, attr=name), args=args) if self.is_column(value) and not (
                    isinstance(value, ast.Attribute) and value.attr in ("str", "dt")):
                method, args = True, [value, *args]
            case _:
                return None
        known = METHOD_AGGREGATES if method else AGGREGATES
        if name in QUANTILES and name != "qcut":
            return (name, args, method) if args and self.is_column(args[0]) else None
        wanted = 2 if name in TWO_COLUMNS else 1
        if name in known and len(args) == wanted and not isinstance(args[0], ast.List) and all(map(self.is_column, args)):
            return name, args, method
        return None

    def settled(self, node: ast.expr) -> ast.expr:
        """The tree with its aggregates replaced by their values, innermost level first."""
        while True:
            found = [n for n in ast.walk(node) if self.aggregate(n) or self.quantile_cut(n)]
            inner = [n for n in found if not any(m is not n and m in found for m in ast.walk(n))]
            if not inner:
                return node
            if self.table is None:
                raise ValueError(f"an aggregate needs the table: {ast.unparse(inner[0])}")
            values = self.computed(inner)

            class Put(ast.NodeTransformer):
                def visit(self, n):
                    return values[id(n)] if id(n) in values else self.generic_visit(n)

            node = Put().visit(node)

    def quantile_cut(self, node: ast.AST) -> bool:
        match node:
            case ast.Call(func=ast.Name(id="qcut") | ast.Attribute(attr="qcut"), args=[x, ast.Constant(value=int())]):
                return self.is_column(x)
        return False

    def computed(self, nodes: list[ast.expr]) -> dict[int, ast.expr]:
        from millrace.quantiles import column_quantiles

        sums, ranks, out = [], [], {}
        for n in nodes:
            if self.quantile_cut(n):
                parts = n.args[1].value
                ranks.append((n, self.build(n.args[0]), [i / parts for i in range(parts + 1)]))
                continue
            name, args, method = self.aggregate(n)
            if name in QUANTILES:
                share = 0.5 if name == "median" or len(args) < 2 else float(ast.literal_eval(args[1])) / (100 if name == "percentile" else 1)
                ranks.append((n, self.build(args[0]), [share]))
            else:
                sums.append((n, (METHOD_AGGREGATES if method else AGGREGATES)[name](*map(self.build, args))))
        if sums:
            row = self.table.agg(*[a.alias(f"a{i}") for i, (_, a) in enumerate(sums)]).first()
            out |= {id(n): ast.Constant(value=v) for (n, _), v in zip(sums, row)}
        if ranks:
            wide = self.table.select(*[c.cast("double").alias(f"c{i}") for i, (_, c, _) in enumerate(ranks)])
            shares = sorted({s for *_, many in ranks for s in many})
            got = column_quantiles(wide, wide.columns, shares)
            for i, (n, _, many) in enumerate(ranks):
                values = [got[f"c{i}"][shares.index(s)] for s in many]
                if not self.quantile_cut(n):
                    out[id(n)] = ast.Constant(value=values[0])
                    continue
                # The lowest value belongs to the first bin.
                edges = [math.nextafter(values[0], -math.inf), *values[1:]] if values[0] is not None else [0.0, 0.0]
                out[id(n)] = ast.Call(func=ast.Name(id="cut"), args=[n.args[0], ast.List(elts=[ast.Constant(value=v) for v in edges])], keywords=n.keywords)
        return out

    def argument(self, node: ast.expr):
        """A column, or for a constant or a list the plain value."""
        match node:
            case ast.Constant(value=value):
                return value
            case ast.UnaryOp(op=ast.USub(), operand=ast.Constant(value=value)):
                return -value
            case ast.List(elts=elts) | ast.Tuple(elts=elts) | ast.Set(elts=elts):
                return [self.argument(e) for e in elts]
        return self.build(node)

    def call(self, function: Callable, args: Sequence, keywords: Sequence[ast.keyword], columns: int) -> Column:
        """``columns``: how many of the first arguments must be columns even if constant."""
        given = [self.build(a) if i < columns and not isinstance(a, ast.List) else self.argument(a) for i, a in enumerate(args)]
        try:
            return function(*given, **{k.arg: self.argument(k.value) for k in keywords})
        except TypeError as e:
            raise ValueError(f"wrong arguments: {e}") from e

    def build(self, node: ast.AST) -> Column:
        match node:
            case ast.Name(id=name) if name in self.names:
                return F.col(f"`{self.names[name]}`")
            case ast.Subscript(value=ast.Name(id="df"), slice=ast.Constant(value=name)) | ast.Attribute(value=ast.Name(id="df"), attr=name) if name in self.names:
                return F.col(f"`{self.names[name]}`")
            case ast.Name(id=name) | ast.Attribute(value=ast.Name(id="np" | "math" | "numpy"), attr=name) if name in CONSTANTS:
                return F.lit(CONSTANTS[name])
            case ast.Constant(value=value):
                return F.lit(value)
            case ast.List(elts=elts):
                return F.array(*map(self.build, elts))
            case ast.Subscript(value=ast.Call(func=ast.Name(id="get_dummies") | ast.Attribute(value=ast.Name(id="pd" | "pandas"), attr="get_dummies"), args=[x]),
                               slice=ast.Constant(value=level)):
                return F.coalesce(self.build(x) == F.lit(level), F.lit(False))
            case ast.Subscript(value=ast.Attribute(value=value, attr="str"), slice=ast.Constant() | ast.UnaryOp() as at) if isinstance(self.argument(at), int):
                return TEXT_METHODS["get"](self.build(value), self.argument(at))
            case ast.Subscript(value=value, slice=ast.Constant() | ast.UnaryOp() as at) if isinstance(self.argument(at), int):
                return TEXT_METHODS["get"](self.build(value), self.argument(at))
            case ast.BinOp(left=left, op=op, right=right) if type(op) in _BINARY:
                return _BINARY[type(op)](self.build(left), self.build(right))
            case ast.UnaryOp(op=op, operand=x) if type(op) in _UNARY:
                return _UNARY[type(op)](self.build(x))
            case ast.BoolOp(op=op, values=values):
                return reduce(_BOOL[type(op)], map(self.build, values))
            case ast.IfExp(test=test, body=yes, orelse=no):
                return F.when(self.build(test), self.build(yes)).otherwise(self.build(no))
            case ast.Compare(left=left, ops=[ast.In() | ast.NotIn() as op], comparators=[ast.List(elts=elts) | ast.Tuple(elts=elts) | ast.Set(elts=elts)]):
                found = self.build(left).isin([self.build(e) for e in elts])
                return found if isinstance(op, ast.In) else ~found
            case ast.Compare(left=left, ops=[ast.Is() | ast.IsNot() as op], comparators=[ast.Constant(value=None)]):
                return self.build(left).isNull() if isinstance(op, ast.Is) else self.build(left).isNotNull()
            case ast.Compare(left=left, ops=ops, comparators=right) if all(type(o) in _COMPARE for o in ops):
                sides = [self.build(left), *map(self.build, right)]
                tests = [_COMPARE[type(o)](a, b) for o, a, b in zip(ops, sides, sides[1:])]
                return reduce(lambda a, b: a & b, tests)
            case ast.Attribute(value=ast.Attribute(value=x, attr="dt"), attr=part) if part in TIME_PARTS:
                return TIME_PARTS[part](self.build(x))
            case ast.Call(func=ast.Attribute(value=ast.Attribute(value=x, attr="dt"), attr=part), args=[], keywords=[]) if part in TIME_PARTS:
                return TIME_PARTS[part](self.build(x))
            case ast.Call(func=ast.Attribute(value=ast.Attribute(value=x, attr="str"), attr=name), args=args, keywords=keywords) if name in TEXT_METHODS:
                return self.call(TEXT_METHODS[name], [x, *args], keywords, 1)
            case ast.Call(func=ast.Attribute(value=ast.Name(id=module), attr=name), args=args, keywords=keywords) if (
                    module in MODULES and module not in self.names and name in FUNCTIONS):
                return self.function(name, args, keywords)
            case ast.Call(func=ast.Attribute(value=x, attr=name), args=args, keywords=keywords) if name in METHODS and not (
                    isinstance(x, ast.Name) and x.id in MODULES):
                return self.call(METHODS[name], [x, *args], keywords, 1)
            case ast.Call(func=ast.Name(id=name), args=args, keywords=keywords) if name in FUNCTIONS:
                return self.function(name, args, keywords)
            case ast.Name(id=name) | ast.Call(func=ast.Name(id=name)):
                raise ValueError(f"unknown name in expression: {name}")
        raise ValueError(f"unsupported expression: {ast.unparse(node)}")

    def function(self, name: str, args: list[ast.expr], keywords: list[ast.keyword]) -> Column:
        if name in ("sub", "search", "match", "linspace", "arange", "zeros", "ones", "date_range", "timedelta"):
            columns = [i for i, a in enumerate(args) if name in ("sub", "search", "match") and i == len(args) - 1]
            given = [self.build(a) if i in columns else self.argument(a) for i, a in enumerate(args)]
            return FUNCTIONS[name](*given, **{k.arg: self.argument(k.value) for k in keywords})
        if name in ("digitize", "interp", "cut", "to_datetime", "to_numeric", "round"):
            return self.call(FUNCTIONS[name], args, keywords, 1)
        if name in ("select", "sum", "sorted", "array"):
            lists = [[self.build(e) for e in a.elts] if isinstance(a, ast.List) else self.build(a) for a in args]
            return FUNCTIONS[name](*lists)
        return self.call(FUNCTIONS[name], args, keywords, len(args))


def along_call(builder: _Builder, node: ast.AST) -> tuple[str, ast.expr, list, tuple] | None:
    """(method, its column, leading arguments, (arguments, keywords)) of a call that looks along an order."""
    match node:
        case ast.Call(func=ast.Attribute(value=ast.Call(func=ast.Attribute(value=x, attr=window), args=args, keywords=keywords), attr=stat), args=[], keywords=[]) if (
                stat in ALONG_WINDOWS.get(window, ()) and builder.is_column(x)):
            return window, x, [stat], (args, keywords)
        case ast.Call(func=ast.Attribute(value=x, attr=name), args=args, keywords=keywords) if name in ALONG and builder.is_column(x) and not (
                isinstance(x, ast.Attribute) and x.attr in ("str", "dt")):
            return name, x, [], (args, keywords)
    return None


def column_expr(text: str, columns: Sequence[str] | DataFrame) -> Column:
    """``text`` over the named columns; any other name raises ``ValueError``."""
    tree, quoted = _parsed(text)
    builder = _Builder(columns, quoted)
    along = next((n for n in ast.walk(tree) if along_call(builder, n)), None)
    if along is not None:
        raise ValueError(f"an order is needed (order_by): {ast.unparse(along)}")
    return builder.build(builder.settled(tree))
