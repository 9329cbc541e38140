"""Importance resampling, prefix trie and packing: against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from millrace.llm import packing, queries, resample, trie

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# ---- resampling

def runs(text, n, buckets):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), collections.Counter(
        zlib.crc32(" ".join(w[i:i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1))


def brute_resample(docs, goal, n=1, buckets=10_000, percent=10, least=20, seed=2024):
    """docs: (id, text). Rows as (id, n_features, weight, score, rank), in order of rows."""
    made = [runs(t, n, buckets) for _, t in docs]
    s, t = sum((m[1] for m in made), collections.Counter()), sum((runs(x, n, buckets)[1] for x in goal), collections.Counter())
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (big_s + buckets) / ((s[b] + 1.0) * (big_t + buckets))))
    rows = []
    for (i, _), (words, found) in zip(docs, made):
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(c * gain(b) for b, c in found.items())
        rows.append((i, sum(found.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    order = sorted((r for r in range(len(rows)) if rows[r][4] >= least), key=lambda r: (-rows[r][3], rows[r][0] is not None, rows[r][0] or 0))
    rank = {r: k + 1 for k, r in enumerate(order[:percent * len(order) // 100])}
    return [(*row[:4], rank.get(r)) for r, row in enumerate(rows)]


def test_resampling_of_the_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    goal = [r[0] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("text").collect()]
    got = [tuple(r) for r in queries.QUERIES["op11_resample"](spark, FOLDER).collect()]
    want = brute_resample([tuple(d) for d in docs], goal)
    assert sorted(got, key=str) == sorted(want, key=str) and sum(w[4] is not None for w in want) > 5


@pytest.mark.parametrize("n", [1, 2, 3])
@pytest.mark.parametrize("limit", [1, 5, 37, 2_000_000])
def test_runs_across_blocks(n, limit):
    rng = random.Random(n)
    texts = ["", "  ", "a", "A b", "é É ñ2", "x" * 50, "日本 語-word_word9", "\n \n"]
    texts += ["".join(rng.choice("abAB é9 ,-\n\x00日") for _ in range(rng.randint(0, 200))) for _ in range(60)]
    got, words = [collections.Counter() for _ in texts], np.zeros(len(texts), int)
    for owner, found, docs, counts in resample.Features(n, 997, limit).of(texts):
        np.add.at(words, docs, counts)
        for o, b in zip(owner.tolist(), found.tolist()):
            got[o][b] += 1
    assert list(zip(words.tolist(), got)) == [runs(t, n, 997) for t in texts]


def test_resampling_edge_cases(spark, split_always):
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice(["le", "La", "über", "x9", "日本"]) for _ in range(n))
    docs = [(i, say(rng.randrange(0, 40))) for i in range(150)] + [(900, None), (901, ""), (902, say(30_000)), (None, say(25)), (903, "a " * 19)]
    docs += [(i, docs[5][1]) for i in range(1000, 1100)] + [(7, docs[7][1])] * 3
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n_features int, bucket string")
    goal = spark.createDataFrame([("le über",), (None,), ("LE",)], "text string")
    made = resample.resampled(df, goal, n=2, buckets=50, percent=30)
    got = [tuple(r)[:5] for r in made.collect()]
    want = brute_resample(docs, ["le über", None, "LE"], 2, 50, 30)
    key = lambda r: (str(r[0]), r[1:4], r[4] or 0)
    assert sorted(got, key=key) == sorted(want, key=key)
    chosen = resample.drawn(df, goal, n=2, buckets=50, percent=30)
    assert chosen.columns == df.columns
    assert sorted(str(r.doc_id) for r in chosen.collect()) == sorted(str(w[0]) for w in want if w[4])
    assert resample.resampled(df.limit(0), goal).count() == 0
    assert {r[4] for r in resample.resampled(df, goal.limit(0), percent=0).collect()} == {None}


# ---- trie

def brute_trie(rows, family=100, shared=6):
    """rows: (conv, turn, role, text). {(conv_id, depth): other columns}."""
    own = collections.defaultdict(list)
    for c, n, role, text in rows:
        own[c].append((n is not None, n or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % shared
        whole[c] = tuple((own.get(c - c % family, []) if c is not None else [])[:h] + turns[h:])
    order = sorted(whole, key=lambda c: (c is None, c or 0))
    members = collections.defaultdict(list)
    for c in order:
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    below = collections.Counter(n[:-1] for n in members if n)
    leaves, saved = collections.Counter(), collections.Counter()
    for n, convs in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += below[n] == 0
            saved[n[:d]] += (len(convs) - 1) * len(n[-1][1]) if n else 0
    return sorted(((convs[0], len(n), members[n[:-1]][0] if n else None, len(convs), below[n], leaves[n], saved[n], hashlib.sha256(",".join(
        "null" if c is None else str(c) for c in convs if len(whole[c]) == len(n)).encode()).hexdigest()) for n, convs in members.items()), key=str)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_trie_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in queries.QUERIES["op12_prefix_trie"](spark, FOLDER).collect()), key=str)
    assert got == brute_trie(rows) and len(got) > 20


def table_of_turns():
    rng = random.Random(5)
    rows = [(c, t if rng.random() < 0.95 else None, rng.choice(["user", None, ""]), rng.choice(["a", "bb", None, "日本"]))
            for c in [*range(0, 12), 100, 101, 102, 205, 207, 5000, 9001] for t in range(rng.randrange(1, 7))]
    rows += [(c, t, "user", "same") for c in range(300, 360) for t in range(3)]  # many copies
    rows += [(400, t, "user", "ab"[t * t // 7 % 2]) for t in range(150)]  # one long conversation
    rows += [(401, t, "user", "ab"[t * t // 7 % 2]) for t in range(140)] + [(None, 0, "user", "same"), (None, 1, "x", "y")] + [(3, 1, "user", "a")] * 2
    return rows


@pytest.mark.parametrize("height", [2, 3, 8])
def test_trie_bands(spark, split_always, height):
    rows = table_of_turns()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, k1 string")
    got = trie.trie(df, height=height).select(*TRIE)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_trie(rows)


def test_trie_edge_cases(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.trie(empty).count() == 0
    rows = [(c, 0, "user", "x" * 100_000) for c in (2, 1, 7)]  # h is not 0 for some, so that they lose their only turn
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted((tuple(r) for r in trie.trie(df).select(*TRIE).collect()), key=str) == brute_trie(rows)
    assert sorted((tuple(r) for r in trie.trie(df, shared=1).select(*TRIE).collect()), key=str) == brute_trie(rows, shared=1)


# ---- packing

def check_packing(rows, docs, window, end=2, text_ids=None):
    """Every id in one piece, gapless sequences within the window; returns (padding, sequences, pieces)."""
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(docs)
    for d, ids in docs.items():
        whole = [*ids, end]
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            part = np.array(whole[at:at + r["length"]], "<u4").tobytes()
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(whole) and r["ids_crc32"] == zlib.crc32(part)
            at += r["length"]
        assert at == len(whole)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding, len(by_sequence), len(rows)


def test_packing_of_the_table(spark):
    library = Tokenizer.from_file(queries.vocabulary())
    docs = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = [r.asDict() for r in queries.QUERIES["op13_packing"](spark, FOLDER).collect()]
    padding, sequences, pieces = check_packing(rows, docs, 4096)
    tokens = sum(len(i) + 1 for i in docs.values())
    assert padding == 0 and sequences <= tokens // 4096 + 13 * 8 and pieces <= len(docs) + 2 * sequences


def test_sum_of_squares_choices():
    def brute(count, size, window):
        best = {}
        for h in range(window - size + 1):
            if h == 0 or count[h]:
                after = collections.Counter(count)
                after[h] -= h > 0
                after[h + size] += h + size < window
                best[h] = sum(n * n for n in after.values())
        return max(h for h in best if best[h] == min(best.values()))

    rng, window = random.Random(3), 24
    packer, count = packing.Packer(window), collections.Counter()
    for i in range(600):
        size = rng.choice([1, 3, 5, 7, 11, 13, 23])
        h = brute(count, size, window)
        count[h] -= h > 0
        count[h + size] += h + size < window
        packer.add(i, np.arange(size))
        assert all(packer.count[k] == count[k] == len(packer.open[k]) for k in range(1, window))
    assert packer.count.sum() < 60
    packer.cut()
    sizes = [sum(len(p[2]) for p in s) for s in packer.closed]
    assert all(n == window or n & (n - 1) == 0 for n in sizes) and sum(n != window for n in sizes) <= 5


@pytest.mark.parametrize("most", [3, 8192])
def test_packing_edge_cases(spark, most):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice(["le", "über", "x9", "日本", "<|endoftext|>"]) for _ in range(rng.randrange(0, 60)))) for i in range(200)]
    docs += [(900, None), (901, ""), (902, "a b c " * 5000), (903, "x" * 5000), (904, "<|startoftext|>a"), (-1, "\n \t")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, start int, key string")
    library = Tokenizer.from_file(queries.vocabulary())
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in docs}
    got = packing.packed(df, queries.vocabulary(), window=64, most=most, ids=True)
    rows = [r.asDict() for r in got.collect()]
    assert check_packing(rows, want, 64)[0] == 0
    assert all(r["ids"] == [*want[r["doc_id"]], 2][r["start"]:r["start"] + r["length"]] for r in rows)
    twice = packing.packed(df.where("doc_id BETWEEN 0 AND 2").union(df.where("doc_id BETWEEN 0 AND 2")).union(df.selectExpr("CAST(NULL AS LONG)", "text", "start", "key").limit(2)), queries.vocabulary())
    assert twice.groupBy("doc_id").count().count() == 4
    assert packing.packed(df.limit(0), queries.vocabulary()).count() == 0
