"""Substring and SimHash de-duplication, decontamination: against brute force."""

import collections
import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from millrace.llm import decontaminate, links, queries, simhash, substrings
from test_edited_passages import brute_passages

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return dict(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect())


def brute_substrings(rows, window):
    """rows: (id, text) in order."""
    seen, out = set(), []
    split = [(i, WORD.findall(t or "")) for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))]
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            win = tuple(w[k:k + window])
            if win in seen:
                gone.update(range(k, k + window))
            seen.add(win)
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def test_substrings_of_the_table(spark, texts):
    got = [tuple(r) for r in queries.QUERIES["op4_substring_dedup"](spark, FOLDER).collect()]
    want = brute_substrings(list(texts.items()), 20)
    assert sorted(got) == sorted(want) and any(w[2] for w in want)


def test_substring_edge_cases(spark):
    rng = random.Random(1)
    make = lambda n: " ".join(rng.choice("abcdef") + rng.choice("xyz") for _ in range(n))
    shared = make(30)
    rows = [(1, shared), (2, make(5) + "\n" + shared + " " + make(4)), (3, None), (4, ""), (5, "a " * 60), (6, make(3)), (7, shared), (None, shared)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, chunk string")
    # one plan; prefixes split by the whole window; hashes that collide, so that words must decide
    for group, least, bits in ((2_000_000, 64, 32), (7, 1, 32), (2_000_000, 1, 1)):
        out = substrings.deduplicated(df, texts=True, group=group, least=least, filter_bits=bits).collect()
        assert sorted((r[:4] for r in map(tuple, out)), key=str) == sorted(brute_substrings(rows, 20), key=str)
    spans = {r.doc_id: r.spans for r in out}
    assert spans[7] == [[0, 30]] and spans[3] == [] and spans[None] == []
    twice = spark.createDataFrame([(1, shared), (1, shared)], "doc_id long, text string")
    assert sorted(r.n_removed for r in substrings.deduplicated(twice).collect()) == [0, 30]
    assert substrings.deduplicated(df.limit(0)).count() == 0


def test_substrings_of_few_words(spark):
    """Short windows over two words: many repeats inside a chunk, deep ties, several documents in several chunks."""
    rng = random.Random(4)
    rows = [(rng.randrange(40), " ".join(rng.choice("ab") for _ in range(rng.randrange(30)))) for _ in range(60)]
    rows = [(i, t) for i, t in dict(rows).items()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for window in (1, 2, 5, 9):
        for group, bits in ((2_000_000, 32), (5, 2)):
            out = substrings.deduplicated(df, window=window, group=group, least=2, filter_bits=bits).collect()
            assert sorted(map(tuple, out)) == sorted(brute_substrings(rows, window))


def test_order_and_depth_of_suffixes():
    rng = np.random.default_rng(5)
    for size in (1, 3, 70_000):
        paths = rng.integers(0, size, (300, 20)).astype(np.int32)
        paths[100:200] = paths[:100]
        paths[200:, :12] = paths[:100, :12]
        order, depth = substrings.tree_order(paths, size)
        rows = [tuple(paths[i]) for i in order]
        assert rows == sorted(rows)
        shared = [next((k for k in range(20) if a[k] != b[k]), 20) for a, b in zip(rows, rows[1:])]
        assert depth.tolist() == [0, *shared]


def test_words_of_odd_texts():
    every = [chr(i) for i in range(256)] + ["\u2003", "\u3000", "\u4f60", "\U0001f600", "a", "b"]
    rng = random.Random(7)
    texts = ["".join(rng.choice(every) + "a" * rng.randrange(2) for _ in range(rng.randrange(40))) for _ in range(300)] + [None, "", " \x1c \n", " a  b "]
    keys = np.array([rng.randrange(50) for _ in texts])
    order = np.argsort(keys, kind="stable").tolist()
    for kind in (pa.string(), pa.large_string()):
        words = substrings.Words.read(keys, pa.array([None, *texts], kind)[1:])
        split = [WORD.findall(texts[i] or "") for i in order]
        assert words.keys.tolist() == sorted(keys.tolist()) and words.counts.tolist() == [len(x) for x in split]
        assert [words.vocabulary[c].decode() for c in words.codes.tolist()] == [w for x in split for w in x]
        assert (np.diff(np.bincount(words.codes)) <= 0).all()  # commonest first
        empty = substrings.Words.read(np.array([3, 1]), pa.array(["", None], kind))
        assert empty.vocabulary == [] and empty.counts.tolist() == [0, 0] and empty.keys.tolist() == [1, 3]


def test_distinct_windows_cost_a_sort():
    rng = np.random.default_rng(8)
    for n in (0, 1, 1000):
        few = rng.integers(0, 99, n).astype(np.uint64)
        assert substrings.distinct(few).tolist() == sorted(set(few.tolist()))
    names = (rng.integers(0, 64, 600_000) << 32 | rng.integers(0, 1 << 32, 600_000)).astype(np.uint64)
    took = {}
    for f in (np.sort, substrings.distinct) * 3:
        began = time.process_time()
        f(names)
        took[f] = min(took.get(f, 9), time.process_time() - began)
    assert took[substrings.distinct] < 5 * took[np.sort] + 0.02  # np.unique took 40 times a sort


def test_anchors_and_stretches():
    rng = np.random.default_rng(6)
    values = rng.integers(0, 5, 200).astype(np.uint64) << np.uint64(40)
    for size in (1, 2, 5, 7, 16):
        assert substrings.least_places(values, size).tolist() == [i + int(values[i:i + size].argmin()) for i in range(201 - size)]
    at, doc = np.array([3, 4, 9, 30, 36, 37]), np.array([0, 0, 0, 0, 1, 1])
    places, of = substrings.stretches(at, doc, 6)
    assert [places[o:o + 6].tolist() for o in of] == [list(range(a, a + 6)) for a in at] and len(places) == 12 + 6 + 7


def test_prefixes_grow_until_a_group_fits():
    prefixes = substrings.Prefixes(20)
    hashes = np.array([1, 2, 3, 4, 5] * 400, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    hashes[:600] = hashes[0]  # one word makes up the first third
    hashes[600:] += np.arange(1400, dtype=np.uint64) // np.uint64(50)
    at = np.arange(len(hashes) - 19)
    slots = prefixes.slots(hashes, at)
    counts = np.array([np.bincount((s % np.uint64(substrings.SLOTS)).astype(int), minlength=substrings.SLOTS) for s in slots])
    prefixes.plan(counts, 700, 1)
    groups = prefixes.groups(slots)
    assert np.bincount(groups).max() <= 700 and (prefixes.base >= 0).any(1).sum() >= 2
    for n in np.unique(slots[-1]):
        assert len(set(groups[slots[-1] == n])) == 1  # equal windows meet


def brute_fingerprint(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(w)
    s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """prints: {id: fingerprint}; {id: least id reachable}."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    values = np.array([prints[i] for i in ids], np.uint64)
    for k, i in enumerate(ids):
        for j in np.nonzero(np.bitwise_count(values[:k] ^ values[k]) <= 2)[0]:
            a, b = sorted((find(i), find(ids[j])))
            root[b] = a
    return {i: find(i) for i in ids}


def test_simhash_of_the_table(spark):
    texts = dict(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op5_simhash_groups"](spark, "/root/testdata/sf0.01").collect()}
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = brute_components(prints)
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in texts}
    assert len(set(want.values())) < len(want)


def test_dense_families_of_fingerprints(spark):
    rng = random.Random(2)
    values = set()
    for _ in range(6):
        at = rng.getrandbits(64)
        for _ in range(300):  # chains and dense clusters
            at ^= 1 << rng.randrange(64) if rng.random() < 0.3 else 0
            values.add(at ^ (1 << rng.randrange(64)))
    values |= {rng.getrandbits(64) for _ in range(500)} | {0, 3, 7, (1 << 64) - 1}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    found = dict(links.components(simhash.links(spark.createDataFrame(signed, "fp long"))).collect())
    want = brute_components({v: v for v in values})
    group = collections.defaultdict(set)
    for (v,) in signed:
        group[found.get(v, v)].add(v % (1 << 64))
    brute = collections.defaultdict(set)
    for v, r in want.items():
        brute[r].add(v)
    assert sorted(map(sorted, group.values())) == sorted(map(sorted, brute.values()))


def test_simhash_edge_cases(spark):
    rows = [(3, "a b c d"), (1, "a b c d"), (2, None), (4, ""), (5, "A  B\tc d"), (None, "q r s t u v"), (6, "x"), (6, "x")]
    df = spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "doc_id long, text string, fp int, root string")
    got = {(r.doc_id, r.text_hash): r.component_id for r in simhash.grouped(df).collect()}
    assert sorted({(k[0], v) for k, v in got.items()}, key=str) == sorted({(3, 1), (1, 1), (5, 1), (2, 2), (4, 2), (None, None), (6, 6)}, key=str)
    kept = simhash.dedupe(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 6, None], key=str)
    assert simhash.dedupe(df.limit(0)).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edited_passages_are_found(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(say(rng.randrange(5, 35)))) for i in range(8)] + [(90, None), (91, ""), (92, "one")]
    docs = []
    for d in range(24):
        item = items[d % 8][1].split()
        for _ in range(rng.randrange(0, int(0.2 * len(item)) + 1)):
            at, kind = rng.randrange(len(item) + 1), rng.randrange(3)
            item[at:at + (kind != 1)] = [] if kind == 2 else [rng.choice(words)]
        docs.append((d, " ".join(say(rng.randrange(0, 20)) + item + say(rng.randrange(0, 20))).upper()))
    docs += [(100, None), (101, ""), (102, " ".join(say(300))), (103, "one")]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = {(r.doc_id, r.item_id): (r.edits, r.first_word) for r in decontaminate.matches(df.drop("item_id"), bench).collect()}
    want = brute_passages([(d, t or "") for d, t in docs], [(i, t) for i, t in items if t])
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want)
    assert all(got[k][0] >= want[k][0] for k in got) and sum(got[k] == want[k] for k in got) >= 0.9 * len(got)
    left = decontaminate.clean(df, bench)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in got}
    assert decontaminate.matches(df.drop("item_id"), bench.limit(0)).count() == 0 and decontaminate.clean(df, bench.limit(0)).count() == len(docs)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, decontaminate.matches(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 300)
    assert sorted(map(tuple, decontaminate.matches(docs, bench).collect())) == whole and whole


def test_distances_are_exact_up_to_the_bound():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 5, (200, 12)), rng.integers(0, 5, (200, 12))
    b[:100] = np.roll(a[:100], 1, axis=1)
    want = [edit_distance(x.tolist(), y.tolist()) for x, y in zip(a, b)]
    got = decontaminate.distances(a, b, 5)
    assert all(g == w if w <= 5 else g > 5 for g, w in zip(got.tolist(), want))


def test_fingerprints_do_not_depend_on_slices(monkeypatch):
    rng = random.Random(8)
    texts = [None, "", " ", "a", "a b", "a b c", "A  B\tC d", "x" * 300, "a b c d e " * 50_000]
    texts += [" ".join(rng.choice("abcde") * rng.randint(1, 3) for _ in range(rng.randint(0, 60))) for _ in range(100)]

    def brute(text):
        w = (text or "").encode().lower().split()
        made = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in made) > len(made))

    want = [brute(t) for t in texts]
    assert simhash.fingerprint_values(texts).tolist() == want
    monkeypatch.setattr(simhash, "SLICE_BYTES", 7)
    monkeypatch.setattr(simhash, "HASHES_HELD", 20)
    assert simhash.fingerprint_values(texts).tolist() == want
