"""Benchmark decontamination: passages within a share of word edits of a benchmark item.

For an item of ``n`` words, document windows of ``n`` words are embedded by random walks that turn edit distance into Hamming
distance: at each of ``3 n`` steps the walk writes the word it stands on and moves on or stays by a random bit of (step, word), so
two sequences soon walk in step again after an edit. Each repetition of the bit sampling takes ``SAMPLED`` places of one of
``WALKS`` walks as a bucket key; the number of repetitions per length is what reaches ``RECALL`` on sequences edited at random as
often as the bound allows, for each kind of edit and for all kinds mixed. Windows that share a bucket with an item are verified by
exact edit distance with a free end: the least over all lengths that a passage within the bound can have, so that words put in or
left out count once each.

A passage within ``k`` edits of an item holds one of any ``k + 1`` pieces of the item unchanged, at most ``k`` words from its place;
other places cannot match and are not embedded. This loses nothing: every place of every document is decided.

The benchmark is sent to the tasks in blocks of at most ``BLOCK_WORDS`` words and the documents are read once a block, so neither
side is ever held whole. Words are compared with A to Z in lower case. Beyond a document's end a window has places that match
nothing, and a passage ends there. Null and empty texts and items match nothing; repeated rows are judged alike; empty tables give empty results.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from millrace.llm.common import ROW, TEXT, bounded_batches, carried, chunks, received, shared_value, words

EDITS, RECALL = 0.2, 0.98
WALKS, SAMPLED, TRIALS, SEED = 4, 3, 64, 5
#: Edits of the trials that set the repetitions: all kinds, replacements, insertions, deletions.
KINDS = ((0, 1, 2), (0,), (1,), (2,))
BLOCK_WORDS = 2_000_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit value of each."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def embedded(ids: np.ndarray, walk: int) -> np.ndarray:
    """The walk's embedding, three times as wide, of each row of word ids; -1 stands past the row's end."""
    m, n = ids.shape
    padded = np.concatenate([ids, np.full((m, 1), -1, ids.dtype)], axis=1)
    at, row = np.zeros(m, np.int64), np.arange(m)
    out = np.empty((m, 3 * n), ids.dtype)
    coin = _mixed(padded.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SEED + walk))
    for step in range(3 * n):
        out[:, step] = padded[row, at]
        # 64 coin tosses per word from one mixed value, then the next 64.
        if step and step % 64 == 0:
            coin = _mixed(coin + np.uint64(0x9E3779B97F4A7C15))
        toss = (coin[row, at] >> np.uint64(step % 64)) & np.uint64(1)
        at = np.minimum(at + toss.astype(np.int64), n)
    return out


def _places(n: int, repetitions: int) -> np.ndarray:
    return np.random.default_rng([SEED, n]).integers(0, 3 * n, (repetitions, SAMPLED))


def keys(ids: np.ndarray, repetitions: int) -> np.ndarray:
    """Bucket keys of each row: one per repetition."""
    n, out = ids.shape[1], np.empty((len(ids), repetitions), np.uint64)
    places = _places(n, repetitions)
    for walk in range(min(WALKS, repetitions)):
        made = embedded(ids, walk).astype(np.int64).view(np.uint64)
        for r in range(walk, repetitions, WALKS):
            key = np.full(len(ids), r, np.uint64)
            for p in places[r]:
                key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + made[:, p])
            out[:, r] = key
    return out


def edited(ids: np.ndarray, edits: int, rng: np.random.Generator, kinds: tuple[int, ...] = (0, 1, 2)) -> np.ndarray:
    """``ids`` after random replacements (0), insertions (1) and deletions (2), filled to ``edits`` words more."""
    out, fresh = ids.tolist(), int(ids.max()) + 1
    for i, kind in enumerate(rng.choice(kinds, edits)):
        at = int(rng.integers(0, max(1, len(out))))
        out[at:at + (kind != 1)] = [] if kind == 2 else [fresh + i]
    fill = [fresh + edits + i for i in range(len(ids) + edits - len(out))]
    return np.array(out + fill, ids.dtype)


def repetitions(n: int, edits: int, recall: float = RECALL) -> int:
    """The least number of repetitions, doubling, at which sequences of ``n`` words are found and verified often enough after edits
    of each kind and of all kinds."""
    rng = np.random.default_rng([SEED, n, edits])
    base = np.arange(1, n + 1, dtype=np.int32)
    trials = np.stack([edited(base, edits, rng, kinds) for kinds in KINDS for _ in range(TRIALS)])
    verified = distances(trials, np.broadcast_to(base, (len(trials), n)), edits, free_end=True) <= edits
    count = WALKS
    while True:
        hit = verified & (keys(trials[:, :n], count) == keys(base[None], count)).any(axis=1)
        if hit.reshape(len(KINDS), TRIALS).mean(axis=1).min() >= recall:
            return count
        count *= 2


def distances(windows: np.ndarray, items: np.ndarray, bound: int, free_end: bool = False) -> np.ndarray:
    """Edit distance of each row of ``windows`` to the row of ``items``, exact up to ``bound`` and above it beyond; with
    ``free_end`` the least over all lengths from the window's first word on."""
    (m, n), longest = items.shape, windows.shape[1]
    wide = 2 * bound + 1
    far = np.int32(n + bound + 1)
    row = np.broadcast_to(np.where(np.arange(wide) >= bound, np.arange(wide) - bound, far).astype(np.int32), (m, wide)).copy()
    for i in range(1, n + 1):
        new = np.full((m, wide), far, np.int32)
        for d in range(wide):
            j = i + d - bound
            if j < 0 or j > longest:
                continue
            best = np.full(m, i, np.int32) if j == 0 else row[:, d] + (items[:, i - 1] != windows[:, j - 1])
            if d + 1 < wide:
                best = np.minimum(best, row[:, d + 1] + 1)
            if d:
                best = np.minimum(best, new[:, d - 1] + 1)
            new[:, d] = best
        row = new
    return row.min(axis=1) if free_end else row[:, bound]


class Index:
    """Items of one block: pieces to find windows, buckets to sift them, word ids to verify them."""

    FACTOR, TABLE = np.uint64(0xD6E8FEB86659FD93), 1 << 20

    def __init__(self, items: list[tuple[object, list[bytes]]], share: float = EDITS, recall: float = RECALL):
        self.share = share
        self.vocabulary: dict[bytes, int] = {}
        self.names, self.ids = [], []
        for name, found in items:
            if found:
                self.names.append(name)
                self.ids.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found], np.int32))
        self.bound = np.array([int(share * len(x)) for x in self.ids], np.int64)
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for i, ids in enumerate(self.ids):
            cuts = np.linspace(0, len(ids), int(self.bound[i]) + 2).astype(int).tolist()
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(b - a, []).append((int(self.rolled(ids, b - a)[a]), i, a))
        self.pieces = {}
        for size, found in pieces.items():
            found.sort()
            hashes = np.array([f[0] for f in found], np.uint64)
            may = np.zeros(self.TABLE, bool)
            may[(hashes >> np.uint64(40)).astype(np.int64) % self.TABLE] = True
            self.pieces[size] = (hashes, np.array([f[1] for f in found]), np.array([f[2] for f in found]), may)
        self.lengths = {}
        for n in sorted({len(x) for x in self.ids}):
            of = np.array([i for i, x in enumerate(self.ids) if len(x) == n])
            rows = np.stack([self.ids[i] for i in of])
            count = repetitions(n, int(share * n), recall)
            buckets = []
            for column in keys(rows, count).T:
                order = np.argsort(column)
                buckets.append((column[order], order))
            self.lengths[n] = (of, rows, count, buckets)

    @classmethod
    def rolled(cls, ids: np.ndarray, size: int) -> np.ndarray:
        """Hash of ``size`` ids from each place on."""
        mixed = _mixed(ids.astype(np.uint64) + np.uint64(1))
        out = np.zeros(max(0, len(ids) - size + 1), np.uint64)
        for i in range(size):
            out = out * cls.FACTOR + mixed[i:i + len(out)]
        return _mixed(out)

    def find(self, texts: list[str]) -> list[tuple[int, object, int, int]]:
        """(text number, item, first word, edits) of the best passage per text and item."""
        split = [t.encode().lower().split() for t in texts]
        counts = np.array([len(s) for s in split], np.int64)
        ids = np.fromiter((i for s in split for i in map(self.vocabulary.get, s, repeat(0))), np.int32, int(counts.sum()))
        ends = np.cumsum(counts)
        starts, items = [], []
        for size, (hashes, of, offset, may) in self.pieces.items():
            rolled = self.rolled(ids, size)
            at = np.nonzero(may[(rolled >> np.uint64(40)).astype(np.int64) % self.TABLE])[0]
            low, high = (np.searchsorted(hashes, rolled[at], side) for side in ("left", "right"))
            times = high - low
            at, which = np.repeat(at, times), np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            inside = np.searchsorted(ends, at, "right") == np.searchsorted(ends, at + size - 1, "right")
            at, which = at[inside], which[inside]
            item, k = of[which], self.bound[of[which]]
            times = 2 * k + 1
            shift = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) - np.repeat(k, times)
            start, text = np.repeat(at - offset[which], times) + shift, np.repeat(np.searchsorted(ends, at, "right"), times)
            good = (start >= ends[text] - counts[text]) & (start < ends[text])
            starts.append(start[good])
            items.append(np.repeat(item, times)[good])
        if not starts:
            return []
        start, item = np.concatenate(starts), np.concatenate(items)
        sizes = np.array([len(x) for x in self.ids])[item]
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for n in np.unique(sizes).tolist():
            for s, i, edits in self._verified(np.unique(start[sizes == n]), n, ids, ends):
                text = int(np.searchsorted(ends, s, "right"))
                got = (edits, s - int(ends[text] - counts[text]))
                best[text, i] = min(best.get((text, i), got), got)
        return [(text, self.names[i], first, edits) for (text, i), (edits, first) in sorted(best.items())]

    def _verified(self, start: np.ndarray, n: int, ids: np.ndarray, ends: np.ndarray):
        of, rows, count, buckets = self.lengths[n]
        k = int(self.share * n)
        for part in range(0, len(start), 2048):
            at = start[part:part + 2048]
            place = at[:, None] + np.arange(n + k)
            windows = np.where(place < ends[np.searchsorted(ends, at, "right")][:, None], ids[np.minimum(place, len(ids) - 1)], -1)
            made, hits = keys(windows[:, :n], count), []
            for r, (column, order) in enumerate(buckets):
                low, high = (np.searchsorted(column, made[:, r], side) for side in ("left", "right"))
                for w in np.nonzero(high > low)[0].tolist():
                    hits.extend((w, i) for i in order[low[w]:high[w]].tolist())
            if hits:
                pairs = np.unique(np.array(hits), axis=0)
                for p in range(0, len(pairs), 4096):
                    w, i = pairs[p:p + 4096].T
                    d = distances(windows[w], rows[i], k, free_end=True)
                    for x in np.nonzero(d <= k)[0].tolist():
                        yield int(at[w[x]]), int(of[i[x]]), int(d[x])


def _blocks(benchmark: DataFrame, item: str, text: str, share: float, recall: float):
    """One index at a time over the items, by hash of their id and text."""
    narrow = carried(benchmark.select(*dict.fromkeys([item, text])), text).select(F.col(ROW)[item].alias("name"), TEXT)
    total = narrow.agg(F.sum(F.size(words(F.col(TEXT))))).first()[0] or 0
    blocks = -(-total // BLOCK_WORDS)
    for b in range(blocks):
        rows = narrow.where(F.pmod(F.xxhash64("name", TEXT), F.lit(blocks)) == b).orderBy("name", TEXT).collect()
        yield Index([(r[0], r[1].encode().lower().split()) for r in rows], share, recall)


def matches(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    share: float = EDITS, recall: float = RECALL,
) -> DataFrame:
    """(key, item, first_word, edits): the best passage of each document for each item it holds."""
    spark = docs.sparkSession
    bounded_batches(spark)
    slim = carried(docs.select(*dict.fromkeys([key, text])), text).select(F.col(ROW)[key].alias("_llm_key"), TEXT)
    kinds = (docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString())
    schema = f"_llm_key {kinds[0]}, _llm_item {kinds[1]}, first_word long, edits long"
    out = spark.createDataFrame([], schema)
    item_type = to_arrow_type(benchmark.schema[item].dataType)
    for index in _blocks(benchmark, item, item_text, share, recall):
        sent = shared_value(spark, index)

        def run(batches, sent=sent):
            held_index = received(sent)
            for batch in batches:
                for part in chunks([batch], TEXT):
                    found = held_index.find(part[TEXT].to_pylist())
                    if found:
                        at, names, first, edits = zip(*found)
                        yield pa.RecordBatch.from_arrays(
                            [part["_llm_key"].take(pa.array(at)), pa.array(names, item_type), pa.array(first, pa.int64()), pa.array(edits, pa.int64())],
                            ["_llm_key", "_llm_item", "first_word", "edits"])

        out = out.union(slim.mapInArrow(run, schema))
    return out.withColumnsRenamed({"_llm_key": key, "_llm_item": item if item != key else f"{item}_found"})


def clean(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    share: float = EDITS, recall: float = RECALL,
) -> DataFrame:
    """The documents that hold no item, all their columns; nothing is shuffled."""
    spark = docs.sparkSession
    bounded_batches(spark)
    out = docs
    for index in _blocks(benchmark, item, item_text, share, recall):
        sent = shared_value(spark, index)

        def run(batches, sent=sent):
            held_index = received(sent)
            for batch in batches:
                for part in chunks([batch], text):
                    held = {f[0] for f in held_index.find([t or "" for t in part[text].to_pylist()])}
                    if len(held) < part.num_rows:
                        yield part.filter(pa.array([i not in held for i in range(part.num_rows)]))

        out = out.mapInArrow(run, out.schema)
    return out
