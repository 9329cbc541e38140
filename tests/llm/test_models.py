"""Katz scores, token files, quality rules: against plain versions."""

import collections
import glob
import math
import os
import re
import tempfile
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import katz, quality, queries, tokens

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_katz(rows, order=katz.ORDER):
    """rows: (id, text); {id: (held, n_tokens, n_known, train_tokens, base, score)} by the definitions, with plain dictionaries."""
    split = [(i, [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t or "")] + [None]) for i, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in split]
    # Histories are tuples of the n - 1 symbols before a word, of which 0 stands before the text.
    seen = [collections.Counter() for _ in range(order + 1)]
    for (_, w), h in zip(split, held):
        for p, x in enumerate(w) if not h else ():
            for n in range(1, min(order, p + 2) + 1):
                seen[n][(*[0, *w][p + 2 - n:p + 1], x)] += 1
    total = sum(seen[1].values())
    factor = [None] + [katz.discounts(np.array([0, *[sum(c == r for c in s.values()) for r in range(1, katz.K + 2)]])) for s in seen[1:]]
    cut = lambda c: min(c, katz.K + 1)
    after = [collections.defaultdict(list) for _ in seen]
    for n in range(2, order + 1):
        for g, c in seen[n].items():
            after[n][g[:-1]].append((g[-1], c))
    left = sum((1 - factor[1][cut(c)]) * c for c in seen[1].values())
    whole = total if left > 0 else total + 1
    weights = {}

    def chance(g):
        n, c = len(g), seen[len(g)][g]
        if n == 1:
            return factor[1][cut(c)] * c / whole if c else (left or 1) / whole
        h = g[:-1]
        if not after[n][h]:
            return chance(g[1:])
        count = sum(x for _, x in after[n][h])
        rest = sum((1 - factor[n][cut(x)]) * x for _, x in after[n][h])
        size = count if rest > 0 else count + 1
        if c:
            return factor[n][cut(c)] * c / size
        if h not in weights:
            weights[h] = (rest or 1) / size / (1 - sum(chance((*g[1:-1], w)) for w, _ in after[n][h]))
        return weights[h] * chance(g[1:])

    out = {}
    for (i, w), h in zip(split, held):
        base = sum(math.log10((seen[1][x,] + 0.5) / (total + 0.5 * (len(seen[1]) + 1))) for x in w)
        score = sum(math.log10(chance((*[0, *w][max(0, p + 2 - order):p + 1], x))) for p, x in enumerate(w))
        out[i] = (h, len(w), sum(seen[1][x,] > 0 for x in w), total, base, score)
    some = [h for n in range(2, order + 1) for h in list(after[n])[:30]]
    return out, {h: sum(chance((*h, w)) for (w,) in [*seen[1], ("never seen",)]) for h in some}


def close(got, want):
    assert set(got) == set(want)
    for i, row in got.items():
        assert row[:4] == want[i][:4] and row[4] == pytest.approx(want[i][4], rel=1e-9) and row[5] == pytest.approx(want[i][5], rel=1e-6), i


def test_katz_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    want, sums = brute_katz(rows)
    assert all(s == pytest.approx(1, abs=1e-9) for s in sums.values())
    got = {r[0]: tuple(r)[1:] for r in queries.QUERIES["op9_katz_scores"](spark, FOLDER).collect()}
    close(got, want)
    lost = [(w[4], w[5]) for w in want.values() if w[0]]
    assert sum(s for _, s in lost) > sum(b for b, _ in lost)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_katz_orders_spread_histories_and_edges(spark, order):
    rows = [(i, "the the the " + " ".join(f"the w{(i * k) % 17}" for k in range(20))) for i in range(40)] + [(50, None), (51, ""), (None, "The end"), (53, "all new here")]
    df = spark.createDataFrame([(i, t, True, 1) for i, t in rows], "doc_id long, text string, held boolean, key int")
    got = {r[0]: tuple(r)[1:] for r in katz.scores(df, order=order, least=16, group=10).collect()}
    want, sums = brute_katz(rows, order)
    close(got, want)
    assert all(s == pytest.approx(1, abs=1e-9) for s in sums.values()) and (sums or order == 1)
    assert katz.scores(df.limit(0), order=order).count() == 0


def zipf_texts(n, words):
    rng = np.random.default_rng(1)
    return [" ".join(f"w{x}" for x in np.minimum(rng.zipf(1.3, words), 50_000)) for _ in range(n)]


def test_katz_sends_a_few_bytes_for_each_gram():
    texts, groups = zipf_texts(40, 2500), 4
    piece = pa.record_batch([pa.array(range(40)), pa.array(texts), pa.array([i % 5 == 1 for i in range(40)])], ["key", katz.TEXT, "held"])
    state, sent = katz.spelled(piece, groups)
    counted = {g: katz.count_words([blob], g, groups) for g, blob in sent}
    sums = np.sum([np.frombuffer(stats, "<i8") for _, stats in counted.values()], axis=0)
    unigrams = katz.Unigrams(int(sums[0]), int(sums[2]), np.concatenate([[0], sums[3:]]), int(sums[1]))
    assert unigrams.documents == 32
    ladder = katz.Ladder(katz.Words(state, {g: r[0] for g, (r, _) in counted.items()}, groups), unigrams)
    factor = unigrams.factor
    for level, most in ((2, 2), (3, 4)):
        blobs = dict(ladder.blobs())
        assert sum(map(len, blobs.values())) < most * len(ladder.next()[0].history)
        answers = {g: katz.count_grams([blob], level, factor) for g, blob in blobs.items()}
        of, spread = np.zeros(katz.K + 2, np.int64), {}
        for _, stats in answers.values():
            seen, names, times, mass = (np.frombuffer(x, k) for x, k in zip(katz.parted(stats), ("<i8", "<i8", "<i8", "<f8")))
            of[1:] += seen
            for h, t, m in zip(names.reshape(-1, level - 1).tolist(), times.reshape(-1, katz.K), mass):
                spread[tuple(h)] = spread.get(tuple(h), 0) + np.append(t, m)
        factor = katz.discounts(of)
        ladder.up({g: r[0] for g, (r, _) in answers.items()}, katz.Level(factor, spread))
    assert np.all(ladder.tokens > 0) and np.all(ladder.tokens <= 1)


@pytest.mark.parametrize("size", [2**10, 2**31])
def test_katz_numbers_round_trip(size):
    rng = np.random.default_rng(2)
    high, low = rng.integers(0, size, 3000) // 300 * 300, rng.integers(0, size, 3000) % 50
    first, at = katz.distinct(high, low)
    pairs = sorted({*zip(high.tolist(), low.tolist())})
    assert [*zip(high[first].tolist(), low[first].tolist())] == pairs and [pairs[i] for i in at] == [*zip(high.tolist(), low.tolist())]
    high, low = np.array(pairs).T
    starts = katz.changes(high)
    assert np.array_equal(katz.unstepped(katz.unsqueezed(katz.squeezed(katz.steps(low, starts))), starts), low)
    assert all(np.array_equal(katz.unsqueezed(katz.squeezed(x)), x) for x in (high, np.zeros(5, int), np.zeros(0, int), np.array([2**40, 0])))


def test_katz_leaves_no_shuffle_files(spark):
    def left():
        top = os.environ.get("SPARK_LOCAL_DIRS") or tempfile.gettempdir()
        return {f: os.path.getsize(f) for at in ("", "*/") for f in glob.glob(f"{top}/{at}blockmgr-*/*/shuffle_*.data")}

    df = spark.createDataFrame(list(enumerate(zipf_texts(40, 2500))), "doc_id long, text string")
    before = left()
    scored = katz.scores(df)
    for _ in range(10):  # they go in the background
        if (more := sum(v for f, v in left().items() if f not in before)) < 100_000:
            break
        time.sleep(0.2)
    assert more < 100_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert scored.count() == 40


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    for ids in (np.zeros(0), np.array([7]), rng.integers(0, 49408, 20000), np.where(rng.random(9000) < 0.02, 2**32 - 1, rng.integers(0, 50, 9000)), np.full(100, 5)):
        ids = ids.astype(np.uint32)
        for size in (64, 8192):
            data = tokens.encode(ids, size)
            assert np.array_equal(tokens.decode(data, block=size), ids)
            assert np.array_equal(tokens.decode(data, 10, 150, size), ids[10:150])
    mixed = np.where(np.arange(8192) % 50 == 0, 40000, np.arange(8192) % 64).astype(np.uint32)
    assert len(tokens.encode(mixed)) < 8192 * 8 / 8 + 200 * 8


def brute_tokens(rows):
    from tokenizers import Tokenizer

    library, at, out = Tokenizer.from_file(queries.vocabulary()), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_files_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.QUERIES["op7_token_files"](spark, FOLDER).collect())) == brute_tokens(rows)


def test_token_edge_cases(spark, tmp_path):
    odd = "A<|endoftext|>b don't  I'LL\u00a0x\u2003y e\u0301 \u0301 \u03a3\u03a3 1234 ##\x1cq\x85z \u4f60\u597d\ud55c \U0001f600\n\t!?"
    rows = [(5, odd), (2, None), (3, ""), (3, "again"), (None, "no id"), (9, "x" * 3000), (9, "x" * 3000)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, part int")
    assert sorted(map(tuple, tokens.encoded(df, queries.vocabulary()).collect()), key=lambda r: r[1]) == brute_tokens(rows)
    tokens.write(df, str(tmp_path / "t"), queries.vocabulary())
    ids = {(r.key, r.start): r.ids for r in tokens.read(spark, str(tmp_path / "t")).collect()}
    assert sum(map(len, ids.values())) == sum(r[2] for r in brute_tokens(rows)) and all(v[-1] == 1 for v in ids.values())
    assert tokens.encoded(df.limit(0), queries.vocabulary()).count() == 0


def brute_measures(t):
    w = WORD.findall(t or "")
    seen, cover = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2)), set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i:i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(cover)


def plain_fit(votes):
    """The same expectation-maximisation over single documents with numpy; (prior, good, bad)."""
    v, n = np.array(votes), len(votes)
    prior, good, bad = quality.PRIOR, np.full(len(quality.RULES), quality.DOWN_GOOD), np.full(len(quality.RULES), quality.DOWN_BAD)
    for _ in range(quality.ROUNDS):
        odds = np.log(prior / (1 - prior)) + np.where(v == 1, np.log((1 - good) / (1 - bad)), np.where(v == -1, np.log(good / bad), 0)).sum(axis=1)
        p = 1 / (1 + np.exp(-odds))
        b = quality.BELIEF * n
        prior = (p.sum() + quality.PRIOR * b) / (n + b)
        good, bad = (
            np.array([(q[v[:, j] == -1].sum() + chance * share * b) / (q[v[:, j] != 0].sum() + share * b) for j in range(v.shape[1])])
            for q, chance, share in ((p, quality.DOWN_GOOD, quality.PRIOR), (1 - p, quality.DOWN_BAD, 1 - quality.PRIOR)))
    return prior, good, bad


def test_quality_of_the_table(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    got = {r.doc_id: r for r in queries.QUERIES["op10_quality_rules"](spark, folder).collect()}
    assert set(got) == set(texts)
    for i, r in got.items():
        want = brute_measures(texts[i])
        assert tuple(r)[1:6] == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    measures = quality.measured(docs)
    model = quality.fit(measures)
    votes = measures.select(*[quality.votes()[rule].alias(rule) for rule in quality.RULES]).collect()
    prior, good, bad = plain_fit([tuple(v) for v in votes])
    assert model.prior == pytest.approx(prior) and [model.chances[r][1] for r in quality.RULES] == pytest.approx(good.tolist())
    assert [model.chances[r][3] for r in quality.RULES] == pytest.approx(bad.tolist())


def test_quality_agrees_with_labels_it_never_saw(spark):
    folder = "/root/testdata/sf0.01"
    labels = dict(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality").collect())
    got = {r.doc_id: r for r in queries.QUERIES["op10_quality_rules"](spark, folder).collect() if r.doc_id in labels}
    judged = [r for r in got.values() if not r.base_failed]
    assert sum(r.kept == (labels[r.doc_id] == 1) for r in judged) >= 0.97 * len(judged)
    assert sum(r.kept for r in judged if labels[r.doc_id] == 1) >= 0.99 * sum(labels[r.doc_id] == 1 for r in judged)


def test_quality_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a b c a b c a b c"), (5, "x " * 5000), (5, "x " * 5000), (None, "one two\none two\n\none two"), (7, "a b c d a b c")]
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, n_words int")
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.judge(df).collect())
    assert got == collections.Counter((i, *brute_measures(t)) for i, t in rows)
    assert quality.keep(df).columns == df.columns
    assert quality.judge(df.limit(0)).count() == 0 and quality.keep(df.limit(0)).count() == 0
