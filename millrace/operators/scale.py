"""Scaling and normalisation: fit one bounded set of numbers, apply as a projection.

``fit`` returns ``{column: parameters}``; ``apply`` needs only those, so a fitted scaler can
be used on other tables and inverted.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.normal import inverse_normal
from millrace.ordered import running_sum
from millrace.quantiles import column_quantiles

QUANTILES = 1000
TINY = 1e-7
POWER_SAMPLE = 10_000


def _stats(df: DataFrame, columns: Sequence[str], **exprs: str) -> dict[str, dict]:
    """The named SQL aggregates (``{c}`` is the column) of all columns in one pass."""
    row = df.selectExpr(*[
        f"{e.format(c=f'`{c}`')} AS {n}_{i}" for i, c in enumerate(columns) for n, e in exprs.items()
    ]).first()
    return {c: {n: row[f"{n}_{i}"] for n in exprs} for i, c in enumerate(columns)}


def fit(df: DataFrame, columns: Sequence[str], method: str, **options) -> dict[str, dict]:
    """Parameters per column. Columns that cannot be scaled get ``type`` = identity."""
    if method == "standard_scaler":
        std = "stddev_samp({c})" if options.get("sample_std") else "stddev_pop({c})"
        return {
            c: {"type": method, "mean": s["mean"], "scale": s["std"] or 1.0}
            for c, s in _stats(df, columns, mean="avg({c})", std=std).items()
        }
    if method == "minmax_scaler":
        low, high = options.get("feature_range", (0.0, 1.0))
        return {
            c: {"type": method, "min": float(s["lo"]), "scale": float(s["hi"] - s["lo"]) or 1.0, "low": low, "high": high}
            for c, s in _stats(df, columns, lo="min({c})", hi="max({c})").items()
        }
    if method == "robust_scaler":
        return {
            c: {"type": method, "median": q[1], "scale": (q[2] - q[0]) or 1.0}
            for c, q in column_quantiles(df, columns, [0.25, 0.5, 0.75], options.get("quantiles", "exact")).items()
        }
    if method == "maxabs_scaler":
        return {c: {"type": method, "scale": float(s["m"]) or 1.0} for c, s in _stats(df, columns, m="max(abs({c}))").items()}
    if method == "log_transform":
        return {
            c: {"type": method, "shift": abs(s["lo"]) + 1.0 if s["lo"] <= 0 else 0.0}
            for c, s in _stats(df, columns, lo="min({c})").items()
        }
    if method == "decimal_scaling":
        return {
            c: {"type": method, "scale": 10.0 ** math.ceil(math.log10(s["m"])) if s["m"] else 1.0}
            for c, s in _stats(df, columns, m="max(abs({c}))").items()
        }
    if method == "mean_normalisation":
        return {
            c: {"type": method, "mean": s["mean"], "scale": float(s["hi"] - s["lo"])} if s["hi"] != s["lo"] else {"type": "identity"}
            for c, s in _stats(df, columns, mean="avg({c})", lo="min({c})", hi="max({c})").items()
        }
    if method == "unit_vector":
        return {
            c: {"type": method, "scale": s["norm"] or 1.0}
            for c, s in _stats(df, columns, norm="sqrt(sum({c} * double({c})))").items()
        }
    if method in ("box_cox", "yeo_johnson"):
        return _fit_power(df, columns, method, options.get("lmbda"))
    if method in ("quantile_normal", "quantile_uniform"):
        return {
            c: {"type": method, "knots": column_knots(df, c, options.get("n_quantiles", QUANTILES))}
            for c in columns
        }
    raise ValueError(f"unknown method {method}")


def _power_sql(method: str, c: str, lam: float) -> str:
    if method == "box_cox":
        return f"ln({c})" if abs(lam) < 1e-12 else f"(power({c}, {lam!r}D) - 1) / {lam!r}D"
    up = f"ln(1 + {c})" if abs(lam) < 1e-12 else f"(power({c} + 1, {lam!r}D) - 1) / {lam!r}D"
    rest = 2 - lam
    down = f"-ln(1 - {c})" if abs(rest) < 1e-12 else f"-(power(1 - {c}, {rest!r}D) - 1) / {rest!r}D"
    return f"CASE WHEN {c} >= 0 THEN {up} ELSE {down} END"


def _fit_power(df: DataFrame, columns: Sequence[str], method: str, lmbda: float | None) -> dict[str, dict]:
    """Maximum-likelihood exponent.

    A bounded sample says where to look; the likelihood of the whole table at five exponents
    around it, for all columns in one aggregate, then moves the centre to the top of a parabola
    until it no longer moves.
    """
    lows = _stats(df, columns, lo="min({c})", n="count({c})")
    use = [c for c in columns if method == "yeo_johnson" or (lows[c]["lo"] or 0) > 0]
    out = {c: {"type": "identity"} for c in columns}
    if not use:
        return out
    jacobian = "ln({c})" if method == "box_cox" else "signum({c}) * ln(1 + abs({c}))"
    at = {c: (lmbda, 0.0) for c in use} if lmbda is not None else _power_start(df, use, method, lows)
    for _ in range(12):
        todo = [c for c in use if at[c][1] > 1e-7]
        if not todo:
            break
        grid = {c: [at[c][0] + k * at[c][1] for k in (-2, -1, 0, 1, 2)] for c in todo}
        row = df.selectExpr(*[
            x for i, c in enumerate(todo) for x in (
                f"count(`{c}`) n{i}", f"sum({jacobian.format(c=f'`{c}`')}) j{i}",
                *[f"var_pop({_power_sql(method, f'`{c}`', lam)}) v{i}_{k}" for k, lam in enumerate(grid[c])],
            )
        ]).first()
        for i, c in enumerate(todo):
            score = [
                (lam - 1) * row[f"j{i}"] / row[f"n{i}"] - math.log(row[f"v{i}_{k}"]) / 2
                for k, lam in enumerate(grid[c])
            ]
            best, step = max(range(5), key=score.__getitem__), at[c][1]
            if best in (0, 4):
                at[c] = grid[c][best], step * 2
                continue
            left, top, right = score[best - 1: best + 2]
            bend = left - 2 * top + right
            shift = 0.0 if bend == 0 else (left - right) / (2 * bend)
            # Below this step the differences drown in rounding.
            at[c] = grid[c][best] + shift * step, 0.0 if step < 0.02 else step / 20
    row = df.selectExpr(*[
        x for i, c in enumerate(use) for x in (
            f"avg({_power_sql(method, f'`{c}`', at[c][0])}) m{i}", f"stddev_pop({_power_sql(method, f'`{c}`', at[c][0])}) s{i}")
    ]).first()
    for i, c in enumerate(use):
        out[c] = {"type": method, "lambda": at[c][0], "mean": row[f"m{i}"], "scale": row[f"s{i}"] or 1.0}
    return out


def _power_start(df: DataFrame, columns: Sequence[str], method: str, counts: Mapping) -> dict[str, tuple[float, float]]:
    """(exponent, step) to start from: the best of a grid on a sample of bounded size."""
    import numpy as np

    most = max(counts[c]["n"] for c in columns)
    part = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    if most > POWER_SAMPLE:
        part = part.sample(fraction=POWER_SAMPLE / most, seed=11)
    rows = part.limit(2 * POWER_SAMPLE).toPandas()
    out = {}
    for c in columns:
        x = rows[c].dropna().to_numpy()
        best, top = 1.0, -math.inf
        for lam in np.linspace(-4, 4, 161):
            if method == "box_cox":
                z, j = (np.log(x) if abs(lam) < 1e-12 else (x**lam - 1) / lam), np.log(x).mean()
            else:
                up, rest = np.maximum(x, 0), 2 - lam
                z = np.where(
                    x >= 0, np.log1p(up) if abs(lam) < 1e-12 else ((up + 1) ** lam - 1) / lam,
                    -np.log1p(np.maximum(-x, 0)) if abs(rest) < 1e-12 else -((np.maximum(-x, 0) + 1) ** rest - 1) / rest)
                j = (np.sign(x) * np.log1p(np.abs(x))).mean()
            var = z.var()
            if var > 0 and np.isfinite(var) and (score := (lam - 1) * j - math.log(var) / 2) > top:
                best, top = float(lam), score
        out[c] = best, 0.1
    return out


def column_knots(df: DataFrame, column: str, m: int = QUANTILES) -> list[float]:
    """``m`` evenly spaced exact quantiles of a column.

    Equal values are counted, ranked by running sums, and each value states which of the m
    wanted ranks it covers, so nothing is sorted in one task and m numbers reach the driver.
    """
    counts = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)").groupBy("v").agg(
        F.count(F.lit(1)).alias("n"))
    ranked = running_sum(counts, ["v"], {"cum": F.col("n")}, totals={"total": F.col("n")})
    hits = ranked.selectExpr(
        "v", "total",
        f"explode(filter(sequence(greatest(0L, bigint(floor((cum - n - 1) * {m - 1}D / greatest(total - 1, 1))) - 1), "
        f"least({m - 1}L, bigint(ceil(cum * {m - 1}D / greatest(total - 1, 1))) + 1)), i -> "
        f"(floor(i * (total - 1) / {m - 1}D) >= cum - n AND floor(i * (total - 1) / {m - 1}D) < cum) OR "
        f"(ceil(i * (total - 1) / {m - 1}D) >= cum - n AND ceil(i * (total - 1) / {m - 1}D) < cum))) AS i",
    )
    ends = hits.groupBy("i").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.max("total").alias("total"))
    part = F.col("i") * (F.col("total") - 1) / (m - 1) - F.floor(F.col("i") * (F.col("total") - 1) / (m - 1))
    rows = ends.select("i", (F.col("lo") + (F.col("hi") - F.col("lo")) * part).alias("q")).orderBy("i").collect()
    return [r["q"] for r in rows]


def quantile_rank(x: Column, knots: Sequence[float]) -> Column:
    """The share of the knots below x, linear in between; ties take the middle of their range."""
    array = F.split(F.lit(",".join(map(repr, knots))), ",").cast("array<double>")
    last = len(knots) - 1
    steps = F.array(*[F.lit(2**i) for i in range(int(math.log2(len(knots))) + 1, -1, -1)])

    def count(test) -> Column:
        return F.aggregate(steps, F.lit(0), lambda at, s: F.when(
            F.coalesce(test(F.get(array, at + s - 1)), F.lit(False)), at + s).otherwise(at))

    le, lt = count(lambda k: k <= x), count(lambda k: k < x)
    below, above = F.get(array, le - 1), F.get(array, le)
    between = le - 1 + (x - below) / (above - below)
    u = F.when(x <= knots[0], F.lit(0.0)).when(x >= knots[-1], F.lit(float(last))).when(
        le > lt, (lt + le - 1) / 2).otherwise(between)
    return F.when(x.isNotNull(), u / last)


def scaled(column: str | Column, p: Mapping) -> Column:
    """One column scaled with fitted parameters."""
    c = (F.col(column) if isinstance(column, str) else column).cast("double")
    match p["type"]:
        case "identity":
            return c
        case "standard_scaler" | "mean_normalisation":
            return (c - p["mean"]) / p["scale"]
        case "minmax_scaler":
            return (c - p["min"]) / p["scale"] * (p["high"] - p["low"]) + p["low"]
        case "robust_scaler":
            return (c - p["median"]) / p["scale"]
        case "maxabs_scaler" | "decimal_scaling" | "unit_vector":
            return c / p["scale"]
        case "log_transform":
            return F.ln(c + p["shift"])
        case "box_cox" | "yeo_johnson":
            raw = F.expr(_power_sql(p["type"], f"`{column}`", p["lambda"]))
            return (raw - p["mean"]) / p["scale"]
        case "quantile_uniform":
            return quantile_rank(c, p["knots"])
        case "quantile_normal":
            u = quantile_rank(c, p["knots"])
            return inverse_normal(F.least(F.greatest(u, F.lit(TINY)), F.lit(1 - TINY)))
    raise ValueError(f"unknown type {p['type']}")


def apply(df: DataFrame, params: Mapping[str, Mapping]) -> DataFrame:
    return df.withColumns({c: scaled(c, p) for c, p in params.items()})


def normalise(df: DataFrame, columns: Sequence[str], method: str, **options) -> tuple[DataFrame, dict]:
    params = fit(df, columns, method, **options)
    return apply(df, params), params


def batch_normalise(df: DataFrame, methods: Mapping[str, Sequence[str]], **options) -> tuple[DataFrame, dict]:
    """Several methods on several columns; every fit reads the unscaled table."""
    params = {}
    for method, columns in methods.items():
        params |= fit(df, columns, method, **options.get(method, {}))
    return apply(df, params), params


def inverse(df: DataFrame, params: Mapping[str, Mapping]) -> DataFrame:
    """Undo every invertible scaling."""
    cells = {}
    for name, p in params.items():
        c = F.col(name)
        match p["type"]:
            case "identity":
                continue
            case "standard_scaler" | "mean_normalisation":
                cells[name] = c * p["scale"] + p["mean"]
            case "minmax_scaler":
                cells[name] = (c - p["low"]) / (p["high"] - p["low"]) * p["scale"] + p["min"]
            case "robust_scaler":
                cells[name] = c * p["scale"] + p["median"]
            case "maxabs_scaler" | "decimal_scaling" | "unit_vector":
                cells[name] = c * p["scale"]
            case "log_transform":
                cells[name] = F.exp(c) - p["shift"]
            case "box_cox":
                raw, lam = c * p["scale"] + p["mean"], p["lambda"]
                cells[name] = F.exp(raw) if abs(lam) < 1e-12 else F.pow(raw * lam + 1, F.lit(1 / lam))
            case "yeo_johnson":
                raw, lam = c * p["scale"] + p["mean"], p["lambda"]
                up = F.exp(raw) - 1 if abs(lam) < 1e-12 else F.pow(raw * lam + 1, F.lit(1 / lam)) - 1
                rest = 2 - lam
                down = 1 - F.exp(-raw) if abs(rest) < 1e-12 else 1 - F.pow(1 - raw * rest, F.lit(1 / rest))
                cells[name] = F.when(raw >= 0, up).otherwise(down)
            case other:
                raise ValueError(f"{other} cannot be inverted")
    return df.withColumns(cells)


def params_table(df: DataFrame, params: Mapping[str, Mapping]) -> DataFrame:
    """One row per column and parameter, to store a fitted scaler."""
    rows = [(c, p["type"], k, float(v)) for c, p in params.items() for k, v in p.items() if isinstance(v, (int, float))]
    return df.sparkSession.createDataFrame(rows, "column string, type string, parameter string, value double")


def normalisation_summary(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, mean/std/min/max before and after): one aggregate per table."""
    def stats(df: DataFrame, tag: str) -> DataFrame:
        rows = ", ".join(
            f"named_struct('column', '{c}', 'mean_{tag}', avg(`{c}`), 'std_{tag}', stddev_samp(`{c}`), "
            f"'min_{tag}', double(min(`{c}`)), 'max_{tag}', double(max(`{c}`)))" for c in columns
        )
        return df.selectExpr(f"array({rows}) AS s").selectExpr("inline(s)")

    return stats(before, "before").join(F.broadcast(stats(after, "after")), "column")


def pca(df: DataFrame, columns: Sequence[str], k: int) -> tuple[DataFrame, list[float]]:
    """Principal components ``PCA_1``.. of the centred columns, and explained variance shares.

    Rows with a missing value get NULL. The largest loading of a component is positive.
    """
    from pyspark.ml.feature import PCA, VectorAssembler

    full = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    means = full.agg(*[F.avg(c).alias(c) for c in columns]).first()
    vec = VectorAssembler(inputCols=list(columns), outputCol="x").transform(
        full.select(*[(F.col(c) - means[c]).alias(c) for c in columns]))
    model = PCA(k=k, inputCol="x", outputCol="z").fit(vec)
    loads = model.pc.toArray()
    out = {}
    for j in range(k):
        w = loads[:, j] * (1 if loads[abs(loads[:, j]).argmax(), j] >= 0 else -1)
        terms = [(F.col(c).cast("double") - means[c]) * float(x) for c, x in zip(columns, w)]
        out[f"PCA_{j + 1}"] = sum(terms[1:], terms[0])
    return df.withColumns(out), [float(v) for v in model.explainedVariance]
