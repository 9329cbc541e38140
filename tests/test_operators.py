"""Worked examples for operators, edge cases, and brute-force comparisons."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions.expressions import column_expr
from millrace.operators import anomaly as A
from millrace.operators import changepoints as CP
from millrace.operators import columns as C
from millrace.operators import compare as K
from millrace.operators import detectors as D
from millrace.operators import forecast as FC
from millrace.operators import fuzzy, missing as M, names as N, profile as P, quality as Q, reshape as R
from millrace.operators import timeseries as T
from millrace.operators import values as V
from millrace.operators.steps import StepStore, run_steps
from millrace.session import cut_lineage, scratch_path
from millrace.sources import readers


def test_missing_golden(spark):
    df = spark.createDataFrame(
        [("Ann", 10.0, "2024-01-01"), (None, None, "2024-01-02"), ("Bob", 30.0, None), ("", None, "2024-01-04"), ("Cy", 5.0, "nan")],
        "`customer name` string, amount double, date string")
    report = {r["column"]: (r["missing"], r["pct"]) for r in M.missing_report(df).collect()}
    assert report == {"customer name": (2, 40.0), "amount": (2, 40.0), "date": (2, 40.0)}
    clean = M.blank_to_null(df)
    out, _ = M.fix_missing(clean, "amount", "custom_number", 0.0)
    out, _ = M.fix_missing(out, "customer name", "custom_text", "NoData")
    assert [r["amount"] for r in out.collect()] == [10.0, 0.0, 30.0, 0.0, 5.0]
    assert out.where("`customer name` = 'NoData'").count() == 2


def test_fill_methods_skip_wrong_types(spark):
    df = spark.createDataFrame([("a", 1), (None, None)], "s string, n int")
    assert M.fix_missing(df, "s", "mean")[0].collect() == df.collect()
    assert M.fix_missing(df, "n", "custom_text", "x")[0].collect() == df.collect()
    assert M.fix_missing(df, "n", "replace")[0].collect()[1]["n"] == 9999
    assert M.fill_all(df, "NoData").collect()[1].asDict() == {"s": "NoData", "n": "NoData"}
    assert M.replace_missing(df.withColumn("e", F.lit(None).cast("int")), "mean").columns == ["s", "n"]


def test_column_name_goldens(spark):
    df = spark.createDataFrame([("x", 1, "d")], "CustomerName string, SalesAmount long, `Transaction Date` string")
    assert N.inflect_columns(df, "underscore").columns == ["customer_name", "sales_amount", "transaction_date"]
    with pytest.raises(ValueError):
        N.inflect_columns(spark.createDataFrame([(1, 2)], "aB int, a_b int"), "underscore")
    words = {"category": "categories", "box": "boxes", "person": "people", "status": "statuses", "analysis": "analyses",
             "knife": "knives", "datum": "data", "day": "days", "Child": "Children", "matrix": "matrices", "bus": "buses"}
    for one, many in words.items():
        assert N.pluralize(one) == many and N.singularize(many) == one
    assert N.pluralize("sheep") == N.singularize("sheep") == "sheep"


def test_special_column_names(spark):
    df = spark.createDataFrame([(1, 2), (3, None)], "`col@name` long, `col#2` long")
    assert {r["column"]: r["missing"] for r in M.missing_report(df).collect()} == {"col#2": 1}
    assert P.describe(df, ["col@name"]).first()["mean"] == 2.0
    assert C.select_columns(df, index_range=(1, 1)).columns == ["col#2"]


def test_first_normal_form(spark):
    df = spark.createDataFrame([(1, "Math, Art", "A"), (2, None, "B")], "id int, courses string, name string")
    assert [r["column"] for r in R.list_like_columns(df).collect()] == ["courses"]
    assert set(map(tuple, R.split_lists(df, ["courses"]).collect())) == {(1, "Math", "A"), (1, "Art", "A"), (2, None, "B")}


def test_expression_rules(spark):
    df = spark.createDataFrame([(7.0, -3.0, 2)], "`unit price (usd)` double, b double, c int")
    value = lambda text: df.select(column_expr(text, df).alias("v")).first()["v"]
    assert value("unit_price_usd % b") == -2.0  # the sign of the divisor
    assert value("unit_price_usd * 2 % 4 + c ** 2 ** 1") == 6.0
    assert value("unit_price_usd / 0") is None
    assert value("gcd(12 * c, 18)") == 6
    assert value("where(b < 0 and not c == 3, 1, 0)") == 1
    assert value("1 < c < 3") is True
    assert value("[c, 1][0]") == 2
    assert value("~(c == 2)") is False and value(" ~ (c == 3) & ~(b > 0)") is True
    assert value("get_dummies(c)[2]") is True and value("pd.get_dummies(c)[3]") is False
    for bad in ("__import__('os')", "nosuch + 1", "b.real", "open('x')", "get_dummies(c)"):
        with pytest.raises((ValueError, SyntaxError)):
            column_expr(bad, df)


def test_text_pieces(spark):
    df = spark.createDataFrame([("a.b c.d",), (" x  y ",), (None,)], "s string")
    value = lambda text: [r[0] for r in df.select(column_expr(text, df)).collect()]
    assert value("s.str.split('.')") == [["a", "b c", "d"], [" x  y "], None]
    assert value("s.str.split()") == [["a.b", "c.d"], ["x", "y"], None]
    assert value("s.str.split('.', 1).str[1]") == ["b c.d", None, None]
    assert value("s.str.split().str.get(-1)") == ["c.d", "y", None]
    assert value("s.str.split('[. ]+')") == [["a", "b", "c", "d"], ["", "x", "y", ""], None]
    assert value("~s.str.contains('b')") == [False, True, None]


def test_edits_and_checks(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", None)], "k int, s string, v double")
    edits = spark.createDataFrame([(2, "v", "5.5"), (1, "s", None)], "k int, column string, value string")
    assert sorted(map(tuple, C.apply_edits(df, edits, ["k"]).collect())) == [(1, None, 1.0), (2, "b", 5.5)]
    with pytest.raises(ValueError):
        C.delete_keys(df, spark.createDataFrame([(9,)], "k int"), ["k"])
    with pytest.raises(ValueError):
        C.rename(df, {"k": "s"})
    with pytest.raises(ValueError):
        C.row_intervals(df, [(0, 2)], ["k"])
    with pytest.raises(ValueError):
        C.add_computed(df, "v", "k + 1")
    assert C.delete_columns(df, ["v", 9])[1] == [9]


def test_flatten(spark):
    df = spark.createDataFrame(
        [(1, {"a": 1, "n": {"x": "5", "y": "q"}}, [1, 2]), (2, None, [])],
        "id int, s struct<a:int,n:struct<x:string,y:string>>, l array<int>")
    out = readers.flatten_nested(df)
    assert set(out.columns) == {"id", "l", "s_a", "s_n.x", "s_n.y"}
    assert out.count() == 3 and dict(out.dtypes)["s_n.x"] == "bigint"
    with pytest.raises(Exception):
        readers.explode_parallel(spark.createDataFrame([([1], [1, 2])], "a array<int>, b array<int>")).collect()


@pytest.mark.parametrize("text,enc", [("plain", "utf-8-sig"), ("héllo", "utf-8-sig")])
def test_guess_encoding(text, enc):
    assert readers.guess_encoding(text.encode("utf-8")) == enc
    assert readers.guess_encoding(text.encode("utf-16")).startswith("utf-16")
    assert readers.guess_encoding("é".encode("latin-1")) == "iso-8859-1"


def test_compare_rows_differ(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0), (3, None)], "k int, v double")
    with pytest.raises(Exception):
        K.compare_columns(a, b, "v", "v", ["k"]).collect()
    assert K.compare_columns(a, a, "v", "v", ["k"]).first()["accuracy"] == 100.0
    assert K.compare_columns(a, a, "v", "v", ["k"], null_safe=False).first()["matches"] == 1


def test_quality(spark):
    assert Q.name_score(["Customer Name"]) == pytest.approx(0.4)
    assert Q.name_score(["customer_name"]) == 1.0
    assert Q.name_score(["123"]) == pytest.approx(0.8)
    df = spark.createDataFrame([("1",), ("text",), ("3.0",), (None,)], "col string")
    assert Q.consistency_score(df).first()[0] == pytest.approx(0.6 + 0.4 * 0.9)


def test_spelling_and_votes(spark):
    vocabulary = spark.createDataFrame([("vacuum", 5), ("cleaner", 3), ("clean", 9)], "word string, freq long")
    terms = spark.createDataFrame([("Vaccum CLEANR",), ("clean",), ("",)], "t string")
    out = V.correct_spelling(terms, "t", vocabulary)  # "clean" is as near as "cleaner" and more frequent
    assert sorted(r["t"] for r in out.collect()) == ["", "Vacuum CLEAN", "clean"]
    votes = spark.createDataFrame(
        [("a", "X"), ("a", "X"), ("a", "Y"), ("b", "X"), ("c", "OLD"), ("d", "d")], "term string, response string")
    got = dict(map(tuple, V.majority_vote(votes, spark.createDataFrame([("OLD",)], "code string")).collect()))
    assert got == {"a": "X", "b": "b", "c": "c", "d": "d"}


def greedy(values, threshold, size):
    def ratio(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        return 200 * row[-1] / (len(a) + len(b))

    out, seen = {}, set()
    for v in values:
        if v in seen:
            continue
        best = sorted(((-ratio(v, w), i, w) for i, w in enumerate(values)))[:size]
        for r, _, w in best:
            if -r >= threshold and w not in seen:
                out[w] = v
                seen.add(w)
    return out


def test_fuzzy_groups_equal_the_sequential_definition(spark):
    rng = np.random.default_rng(2)
    base = ["washing machine", "vacuum cleaner", "electric kettle", "coffee grinder"]
    values = []
    for _ in range(90):
        s = list(base[rng.integers(4)])
        for _ in range(rng.integers(0, 4)):
            s[rng.integers(len(s))] = rng.choice(list("abcxyz"))
        s = "".join(s)
        if s not in values:
            values.append(s)
    df = spark.createDataFrame(list(enumerate(values)), "pos int, term string")
    got = {r["term"]: r["representative"] for r in fuzzy.group_similar(df, "pos", 85).collect()}
    assert got == greedy(values, 85, 5)


@pytest.fixture(scope="module")
def spikes(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=400)
    x[[17, 203, 390]] = [9.0, -8.0, 12.0]
    return spark.createDataFrame(pd.DataFrame({"k": np.arange(400), "v": x, "w": rng.normal(size=400)})).cache()


@pytest.mark.parametrize("model", [m for m in A.MODELS if m not in ("QMCD", "SOD", "SOS", "Sampling")])
def test_detectors_find_spikes(spikes, model):
    found = A.detect(spikes, ["k"], ["v", "w"] if model == "FB" else ["v"], [model]).where("`column` = 'v'")
    rows = {r["k"]: (r["score"], r["label"]) for r in found.collect()}
    assert len(rows) == 400 and all(np.isfinite(s) for s, _ in rows.values())
    assert all(rows[k][1] == 1 for k in (17, 203, 390))


@pytest.mark.parametrize("model", ["SOD", "SOS", "Sampling", "QMCD"])
def test_other_detectors_score_every_row(spikes, model):
    rows = A.detect(spikes, ["k"], ["v"], [model]).collect()
    assert len(rows) == 400 and all(np.isfinite(r["score"]) for r in rows)


@pytest.mark.parametrize("model", ["KNN", "LOF", "ABOD", "ECOD", "MCD", "QMCD"])
def test_split_detectors_equal_plain(spark, spikes, model):
    data = A.preprocess(spikes, ["v"], ["k"]).selectExpr("k", "v AS x")
    plain = D.EXACT[model](data, ["k"]).select("k", "score").toPandas().set_index("k").sort_index()
    spark.conf.set("millrace.smallGroup", "0")
    spark.conf.set("millrace.rowsPerBucket", "70")
    try:
        split = D.EXACT[model](data, ["k"]).select("k", "score").toPandas().set_index("k").sort_index()
    finally:
        spark.conf.unset("millrace.smallGroup")
        spark.conf.unset("millrace.rowsPerBucket")
    np.testing.assert_allclose(split["score"], plain["score"], rtol=1e-9)


def brute_partition(y, penalty, min_size):
    cost = CP.segment_cost(y, "l2")
    places = [*range(0, len(y), CP.JUMP), len(y)]
    best = {0: (0.0, [])}
    for end in places[1:]:
        options = [(best[s][0] + cost(np.array([s]), end)[0] + penalty, best[s][1] + [s]) for s in best if end - s >= min_size]
        if options:
            best[end] = min(options, key=lambda o: o[0])
    return [c for c in best[len(y)][1] if c]


def test_change_points(spark, monkeypatch):
    rng = np.random.default_rng(6)
    y = np.concatenate([rng.normal(m, 1, 100) for m in (0, 8, -4, 3)])
    df = spark.createDataFrame(pd.DataFrame({"t": np.arange(400), "y": y}))
    got = [r["position"] for r in CP.change_points(df, "y", ["t"], penalty_factor=20).orderBy("position").collect()]
    assert got == brute_partition(y, y.std() * 20, 10) == [100, 200, 300]
    monkeypatch.setitem(CP.BLOCK_ROWS, "l2", 130)
    split = [r["position"] for r in CP.change_points(df, "y", ["t"], penalty_factor=20).orderBy("position").collect()]
    assert split == [100, 200, 300]
    monkeypatch.setitem(CP.BLOCK_ROWS, "l1", 200)
    got = [r["position"] for r in CP.change_points(df, "y", ["t"], model="l1", penalty_factor=20).orderBy("position").collect()]
    assert got == [100, 200, 300]
    seg = CP.segments(df, "y", ["t"], CP.change_points(df, "y", ["t"], penalty_factor=20)).orderBy("segment").collect()
    assert [(r["start"], r["end"], r["samples"]) for r in seg] == [(0, 99, 100), (100, 199, 100), (200, 299, 100), (300, 399, 100)]


def test_stationarity(spark, split_always):
    rng = np.random.default_rng(8)
    noise = rng.normal(size=500)
    df = spark.createDataFrame(pd.DataFrame({"t": np.arange(500), "noise": noise, "walk": (noise + 0.3).cumsum()}))
    assert T.stationarity(df, "noise", ["t"]).first()["final_verdict"] == "stationary"
    walk = T.stationarity(df, "walk", ["t"]).first()
    assert walk["adf_pvalue"] > 0.05 and walk["kpss_pvalue"] < 0.05 and walk["final_verdict"] == "non_stationary"
    assert T.stationarity(df, "walk", ["t"], diff_level=1).first()["final_verdict"] == "stationary"


def test_partial_autocorrelation_of_ar1(spark):
    rng = np.random.default_rng(9)
    y = [0.0]
    for e in rng.normal(size=3000):
        y.append(0.7 * y[-1] + e)
    out = T.autocorrelation(spark.createDataFrame(pd.DataFrame({"t": range(3001), "y": y})), "y", ["t"], 5).orderBy("lag").collect()
    assert out[1]["pacf"] == pytest.approx(0.7, abs=0.05) and abs(out[2]["pacf"]) < 0.06


def smoothed(y, alpha, beta, gamma, trend, period):
    """(squared errors, state): additive smoothing, row by row."""
    first = y[:max(period, 1)]
    level, slope = sum(first) / len(first), (y[-1] - y[0]) / (len(y) - 1) if trend else 0.0
    season, sse = [v - level for v in first] if period else [0.0], 0.0
    for t, v in enumerate(y):
        k = t % period if period else 0
        e = v - (level + slope + season[k])
        sse += e * e
        level, slope = level + slope + alpha * e, slope + alpha * beta * e
        season[k] += gamma * (1 - alpha) * e if period else 0.0
    return sse, [level, *([slope] if trend else []), *(season if period else [])]


@pytest.mark.parametrize("trend, period", [(False, 0), (True, 0), (True, 4)])
def test_smoothing_is_exact_over_blocks_and_least(spark, monkeypatch, trend, period):
    rng = np.random.default_rng(10)
    y = rng.normal(size=300).cumsum() + 50 + np.arange(300) * 0.05 + np.tile([3, -1, 0, -2], 75) * (period > 0)
    df = spark.createDataFrame(pd.DataFrame({"_at": range(300), "_y": y}))
    rows = []
    for size in (50_000, 37):
        monkeypatch.setattr(FC, "BLOCK_ROWS", size)
        rows.append(FC.fit_smoothing(df, [], trend, period).first())
    assert rows[0]["_weights"] == pytest.approx(rows[1]["_weights"]) and rows[0]["_state"] == pytest.approx(rows[1]["_state"], rel=1e-9)
    w = rows[0]["_weights"]
    sse, state = smoothed(y.tolist(), *w, trend, period)
    assert rows[0]["_state"] == pytest.approx(state, rel=1e-8)
    for j in range(3):
        for move in (-0.01, 0.01):
            if w[j] and 0 < w[j] + move < 1:
                other = [x + move * (i == j) for i, x in enumerate(w)]
                assert smoothed(y.tolist(), *other, trend, period)[0] >= sse * (1 - 1e-6)


def test_profile_equals_pandas(spark, spikes):
    pdf = spikes.toPandas()["v"]
    for df in (spikes.repartition(1), spikes.repartition(64).orderBy(F.rand(1))):
        r = P.profile_numeric(df, ["v"]).first()
        assert r["skew"] == pytest.approx(pdf.skew()) and r["kurt"] == pytest.approx(pdf.kurtosis())
        assert [r["q05"], r["q50"], r["q95"]] == pytest.approx(pdf.quantile([0.05, 0.5, 0.95]).tolist())


def test_steps(spark):
    store = StepStore(spark, scratch_path(spark, "steps"))
    with pytest.raises(LookupError):
        store.load()
    df = spark.createDataFrame([("1", "x")], "n string, s string")
    store.save(df, "zeta")
    store.save(df.drop("s"), "Alpha step")
    assert dict(store.load("zeta").dtypes)["n"] == "double"
    assert store.load().columns == ["n"]
    store.reset_to("zeta")
    assert [r["step"] for r in store.steps().collect()] == ["zeta"]
    with pytest.raises(KeyError):
        run_steps(df, [("nope", {})], {})


def test_cut_lineage_keeps_rows(spark, spikes):
    assert cut_lineage(spikes).count() == 400
