"""The nearest-neighbour join against brute force: gaps, ties, many cells."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import neighbours as N


def brute(rows, donors, k, width):
    out = {}
    for g, i, x in rows:
        found = []
        for h, key, y, v in donors:
            both = [j for j in range(width) if x[j] is not None and y[j] is not None]
            if g == h and both:
                total = 0.0
                for j in both:
                    total += (x[j] - y[j]) ** 2
                found.append((total * (float(width) / len(both)), key, v))
        if found:
            out[g, i] = sorted(found)[:k]
    return out


def draw(rng, n, width, grid, gaps):
    return [[None if rng.random() < gaps else (float(rng.randrange(grid)) if grid else rng.gauss(0, 1)) for _ in range(width)] for _ in range(n)]


@pytest.mark.parametrize("width, grid, gaps", [(1, 0, 0.0), (2, 6, 0.0), (3, 0, 0.3), (4, 3, 0.2)])
@pytest.mark.parametrize("cell, group", [(4096, 1000), (8, 5)])
def test_nearest_is_exact(spark, monkeypatch, width, grid, gaps, cell, group):
    monkeypatch.setattr(N, "FIT_POINTS", 4)
    rng = random.Random(width * 10 + grid)
    donors = [(rng.randrange(2), i, x, float(i % 7)) for i, x in enumerate(draw(rng, 150, width, grid, gaps))]
    donors += [(0, 1000 + i, [1.0] * width, 0.5) for i in range(40)]  # many copies of one point
    rows = [(rng.randrange(2), i, x) for i, x in enumerate(draw(rng, 60, width, grid, gaps))] + [(0, 500 + i, [1.0] * width) for i in range(20)]
    rows += [(0, 900, [50.0] * width), (1, 901, [None] * width)]
    r = spark.createDataFrame(rows, "_g int, _i long, _x array<double>").select("_g", F.struct("_i").alias("_id"), "_x")
    d = spark.createDataFrame(donors, "_g int, _i long, _x array<double>, _v double").select("_g", F.struct("_i").alias("_key"), "_x", "_v")
    got = {(x["_g"], x["_id"][0]): [(b["_d"], b["_key"][0], b["_v"]) for b in x["_best"]] for x in N.nearest(r, d, 4, width, cell, group).collect()}
    want = brute(rows, donors, 4, width)
    assert set(got) == set(want)
    for at, best in want.items():
        assert [b[1:] for b in got[at]] == [b[1:] for b in best]
        assert [b[0] for b in got[at]] == pytest.approx([b[0] for b in best])


def test_cells_cover_all_points_within_the_bound():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(500, 3))
    tree = N.split_tree(points[::3], 20)
    cells = N.cell_of(tree, points)
    assert len(set(cells.tolist())) == 20 and np.bincount(cells).max() < 80
    asked, bound = rng.normal(size=(40, 3)), rng.random(40)
    rows, visited = N.cells_within(tree, asked, bound)
    near = ((asked[:, None] - points) ** 2).sum(2) <= bound[:, None]
    for q, p in zip(*np.nonzero(near)):
        assert (visited[rows == q] == cells[p]).any()
    assert len(rows) < 40 * 20  # and not simply all of them


def test_others_leave_the_row_out(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0.0, 1.0, rng.random()]), rng.random() if i % 9 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "k long, a double, b double")
    subsets = [["a"], ["a", "b"]]
    got = {(r["_g"], r["_id"][0]): [(n["_d"], n["_key"][0]) for n in r["_near"]] for r in N.others(df, ["k"], subsets, 3).collect()}
    for g, columns in enumerate([(1,), (1, 2)]):
        full = [r for r in rows if all(r[c] is not None for c in columns)]
        for r in full:
            want = sorted((math.sqrt(sum((r[c] - s[c]) ** 2 for c in columns)), s[0]) for s in full if s[0] != r[0])[:3]
            assert [n[1] for n in got[g, r[0]]] == [w[1] for w in want]
            assert [n[0] for n in got[g, r[0]]] == pytest.approx([w[0] for w in want])
    assert len(got) == sum(1 for _ in itertools.chain(rows, (r for r in rows if r[2] is not None)))


def test_empty_tables(spark):
    r = spark.createDataFrame([(0, 1, [1.0])], "_g int, _i long, _x array<double>").select("_g", F.struct("_i").alias("_id"), "_x")
    d = r.select("_g", F.col("_id").alias("_key"), "_x", F.lit(1.0).alias("_v"))
    assert N.nearest(r.limit(0), d, 2, 1).count() == 0 and N.nearest(r, d.limit(0), 2, 1).count() == 0
    assert N.nearest(r, d, 2, 1).first()["_best"][0]["_d"] == 0.0
