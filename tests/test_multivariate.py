"""Detectors over several columns and along orders: the paths that large tables take, against brute force."""

import hashlib
import math
import random
from itertools import combinations

import numpy as np
import pytest

from millrace.operators import multivariate as MV, neighbours as N


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(N, "CELL", 9)
    monkeypatch.setattr(N, "GROUP", 7)
    monkeypatch.setattr(N, "FIT_POINTS", 5)


def table(spark, n=160, width=3, seed=1, copies=True):
    rng = random.Random(seed)
    rows = [(i, *(rng.gauss(0, 1 + j) for j in range(width))) for i in range(n)]
    if copies:
        rows += [(n + i, *rows[3][1:]) for i in range(30)]
    names = [f"c{j}" for j in range(width)]
    return spark.createDataFrame(rows, "k long, " + ", ".join(f"{c} double" for c in names)), rows, names


def others(rows, columns, k):
    out = {}
    for r in rows:
        d = sorted((math.sqrt(sum((r[c + 1] - s[c + 1]) ** 2 for c in columns)), s[0]) for s in rows if s[0] != r[0])
        out[r[0]] = d[:k]
    return out


def brute_lof(rows, columns, k):
    near = others(rows, columns, k)
    own = {i: 1 / (sum(max(near[j][-1][0], d) for d, j in v) / len(v) + 1e-10) for i, v in near.items()}
    return {i: sum(own[j] for _, j in v) / len(v) / own[i] for i, v in near.items()}


def scores(df):
    return {r["k"]: r["score"] for r in df.collect()}


def test_feature_bagging_on_many_cells(spark, small_cells):
    df, rows, names = table(spark)
    got = scores(MV.feature_bagging(df, ["k"], names, k=4, rounds=5))
    want = dict.fromkeys(got, 0.0)
    for columns, n in MV.bags(names, 5).items():
        for i, x in brute_lof(rows, [names.index(c) for c in columns], 4).items():
            want[i] += x * n / 5
    assert len(got) == len(rows) and all(got[i] == pytest.approx(want[i], rel=1e-6) for i in want)


def test_sod_on_many_cells(spark, small_cells):
    df, rows, names = table(spark)
    got = scores(MV.sod(df, ["k"], names, k=6, refs=4))
    near, at = others(rows, range(3), 6), {r[0]: np.array(r[1:]) for r in rows}
    for i, v in near.items():
        mine = {j for _, j in v}
        refs = sorted(((-len(mine & {m for _, m in near[j]}), j) for j in mine))[:4]
        x = np.array([at[j] for _, j in refs])
        use = x.var(0) < 0.8 * x.var(0).mean()
        want = math.sqrt(((at[i] - x.mean(0)) ** 2 * use).sum()) / use.sum() if use.any() else 0.0
        assert got[i] == pytest.approx(want, rel=1e-6, abs=1e-9)
    assert len(set(got.values())) > 50


def test_loci_on_the_split_path(spark, split_always):
    rng = random.Random(2)
    xs = [round(rng.gauss(0, 1), 2) for _ in range(200)] + [0.5] * 60 + [9.0]
    df = spark.createDataFrame(list(enumerate(xs)), "k long, x double")
    got = scores(MV.loci(df, ["k"]))
    spread, x = max(xs) - min(xs), np.array(xs)
    for i, v in enumerate(xs):
        best = 0.0
        for share in MV.LOCI_RADII:
            r = share * spread
            count = lambda w: ((x >= w - 0.5 * r) & (x <= w + 0.5 * r)).sum()
            around = np.array([count(w) for w in x[(x >= v - r) & (x <= v + r)]], float)
            if len(around) >= 20 and around.std() > 1e-6 * around.mean():
                best = max(best, (around.mean() - count(v)) / around.std())
        assert got[i] == pytest.approx(best, abs=1e-6)
    assert got[len(xs) - 1] > 3


def test_lmdd_on_the_split_path(spark, split_always):
    df, rows, names = table(spark, 90, 2)
    got = scores(MV.lmdd(df, ["k"], names, rounds=3))
    want = dict.fromkeys(got, -math.inf)
    for r in (1, 2, 3):
        order = sorted(rows, key=lambda x: hashlib.md5(f"{x[0]}|{r}".encode()).hexdigest())
        x = np.array([o[1:] for o in order])
        for n, o in enumerate(order, 1):
            gain = n * (x[:n].var(0).sum() - x[:n - 1].var(0).sum()) if n > 1 else 0.0
            want[o[0]] = max(want[o[0]], gain)
    assert all(got[i] == pytest.approx(want[i], abs=1e-8) for i in want)


def test_rotation_over_all_triples(spark):
    df, rows, names = table(spark, 120, 4)
    got = scores(MV.rod(df, ["k"], names))
    total = np.zeros(len(rows))
    for t in combinations(range(4), 3):
        x = np.array([[r[c + 1] for c in t] for r in rows])
        m = x.mean(0)
        for _ in range(500):
            d = np.linalg.norm(x - m, axis=1)
            w = np.where(d > 0, 1 / np.where(d > 0, d, 1), 0)
            m = (x * w[:, None]).sum(0) / w.sum()
        v, size = x - m, np.linalg.norm(x - m, axis=1)
        a = np.arccos(np.clip(v @ m / (size * np.linalg.norm(m)), -1, 1))
        low = a <= math.pi / 2
        for part, (lo, hi) in ((low, MV.ROD_ACUTE), (~low, MV.ROD_OBTUSE)):
            a[part] = (a[part] - a[part].min()) / (a[part].max() - a[part].min()) * (hi - lo) + lo
        cost = size**3 * np.cos(a) * np.sin(a) ** 2
        away = np.abs(cost - np.median(cost))
        total += 0.6745 * away / np.median(away)
    assert all(got[r[0]] == pytest.approx(w, rel=1e-5) for r, w in zip(rows, total / 4))
    with pytest.raises(ValueError):
        MV.rod(df, ["k"], names[:2])


def test_kernel_density_far_and_near(spark):
    from millrace.operators import detectors as D

    rng = random.Random(6)
    xs = [rng.gauss(0, 1) for _ in range(300)] + [0.25] * 50 + [-40.0, 7.9, 8.1, 1000.0, 1000.3]
    df = spark.createDataFrame(list(enumerate(xs)), "k long, x double")
    for bandwidth in (1.0, 0.3):
        got = scores(D.kde(df, ["k"], bandwidth))
        for i, v in enumerate(xs):
            total = sum(math.exp(-0.5 * ((v - w) / bandwidth) ** 2) for w in xs) / (len(xs) * bandwidth * math.sqrt(2 * math.pi))
            assert got[i] == pytest.approx(-math.log(total), abs=1e-9)


def brute_sos(x, perplexity, k):
    """Row by row: the ``k`` nearest points that differ, all copies of each, and all own copies."""
    out = np.zeros(len(x))
    for row in x:
        d = ((x - row) ** 2).sum(1)
        points = sorted({(d[i], *x[i]) for i in range(len(x)) if d[i] > 0})[:k]
        held = {p[1:] for p in points}
        me = next(i for i in range(len(x)) if (x[i] == row).all())
        use = [i for i in range(len(x)) if (d[i] == 0 and i != me) or tuple(x[i]) in held]
        away = d[use] - d[use].min()
        low, high = -MV.SOS_RANGE, MV.SOS_RANGE
        for _ in range(60):
            a = np.exp(-np.exp((low + high) / 2) * away)
            p = a / a.sum()
            wide = -(p * np.log(np.where(p > 0, p, 1))).sum() > math.log(perplexity)
            low, high = ((low + high) / 2, high) if wide else (low, (low + high) / 2)
        # Copies of the row bind alike, each to all rows but itself.
        yet = np.zeros(len(x))
        yet[use] = np.log1p(-np.minimum(p, 1 - 1e-12))
        copies = np.flatnonzero(d == 0)
        if len(copies) > 1:
            yet[me] = yet[copies[1]]
            yet[copies] *= (len(copies) - 1) / len(copies)
        out += yet
    return np.exp(out)


@pytest.mark.parametrize("k", [15, 500])
def test_sos_on_many_cells_and_copies(spark, small_cells, k):
    df, rows, names = table(spark)
    got = scores(MV.sos(df, ["k"], names, k=k))
    want = brute_sos(np.array([r[1:] for r in rows]), MV.SOS_PERPLEXITY, k)
    assert len(got) == len(rows) and len({round(x, 9) for x in got.values()}) == 160
    assert all(got[r[0]] == pytest.approx(w, rel=1e-6, abs=1e-9) for r, w in zip(rows, want))


def test_sos_far_points_weigh_little(spark):
    df, rows, names = table(spark)
    x = np.array([r[1:] for r in rows])
    some, whole = brute_sos(x, MV.SOS_PERPLEXITY, MV.SOS_K), brute_sos(x, MV.SOS_PERPLEXITY, len(x))
    assert np.abs(some - whole).max() < 0.08 and np.corrcoef(some, whole)[0, 1] > 0.999


def test_sos_edges(spark):
    lone = spark.createDataFrame([(1, 2.0)], "k long, c0 double")
    assert scores(MV.sos(lone, ["k"], ["c0"])) == {1: 1.0}
    gap = spark.createDataFrame([(1, 2.0), (2, None), (3, 2.0)], "k long, c0 double")
    got = scores(MV.sos(gap, ["k"], ["c0"]))
    assert got[2] is None and got[1] == got[3] == pytest.approx(0, abs=1e-9)
    far = spark.createDataFrame([*((i, i / 10) for i in range(40)), (99, 50.0)], "k long, c0 double")
    got = scores(MV.sos(far, ["k"], ["c0"]))
    assert max(got, key=got.get) == 99 and got[99] > 0.9
    assert MV.sos(lone.limit(0), ["k"], ["c0"]).count() == 0
