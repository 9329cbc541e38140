"""Language-model scores by Katz backoff over n-grams of up to ``ORDER`` words.

Counts up to ``K`` are discounted by Good-Turing estimates, level by level; larger ones are kept. What a history's discounts leave is
shared among the words never seen after it in proportion to their probability after the history without its first word, by a weight
that makes the sum over all words exactly one; and so on down to single words, which leave their own mass to one unknown word. A history
(or the words) without any discounted count is divided by one more than its count, so that something is left. One symbol stands before a
text, and the first tokens have as much history as there is.

Documents travel in chunks, never token by token. First, every chunk sends its distinct words, with their counts in training
documents, to partitions by word, and gets the counts in the whole corpus and a number for each word back; from then on its tokens are
kept as places among its words, and texts are read no more. Then, for each level from pairs up, it sends its distinct
n-grams to partitions by history, as the numbers of their words, in order and as differences, with their counts on the level below, and gets
their counts, how many of the history's successors were seen how often, and the sum of those successors' discounted counts on the level
below. Every level is a table written to the shared folder by partition, and
is worked out from the replies of the levels below it; at last every chunk evaluates its tokens from the highest level down. Histories that
hold more than a fair share of all tokens are spread over several partitions by the next word and put together again (at most four
per partition and level). Counts and bytes sent grow in proportion to the input; messages number chunks times partitions.

Documents learn if crc32 of their id as text, modulo ``FOLDS``, is not ``HELD``; a null id learns. Null and empty texts are one end
token. Repeated rows count and are scored as documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import struct
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from millrace.llm.common import ROW, TEXT, bounded_batches, carried, chunks
from millrace.session import cut_lineage

K = 5
#: Words of the longest n-gram.
ORDER = 3
FOLDS, HELD = 5, 1
#: Tokens whose pairs one partition counts, least partitions, bytes of text of a chunk.
GROUP_TOKENS, LEAST_GROUPS, CHUNK_BYTES = 2_500_000, 48, 6_000_000
#: Hash of the end of a document.
END = 1
#: Numbers of all words that no training document holds, and of what stands before a first token.
UNKNOWN, BEGIN = 0, 2**32 - 1
NAMES = ["bucket", "chunk", "blob"]
SCHEMA = "bucket long, chunk long, blob binary"


def squeezed(values: np.ndarray) -> bytes:
    """Whole numbers from 0, byte by byte: the lowest bytes of all, then the next ones, as far as the largest number needs."""
    rows = np.ascontiguousarray(values, "<u8").view("u1").reshape(-1, 8)
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    squeeze = zstandard.ZstdCompressor(level=1)
    planes = [squeeze.compress(rows[:, k].tobytes()) for k in range(width)]
    return struct.pack(f"<IB{width}I", len(values), width, *map(len, planes)) + b"".join(planes)


def unsqueezed(blob: bytes) -> np.ndarray:
    n, width = struct.unpack_from("<IB", blob)
    rows, at, open_ = np.zeros((n, 8), "u1"), 5 + 4 * width, zstandard.ZstdDecompressor()
    for k, size in enumerate(struct.unpack_from(f"<{width}I", blob, 5)):
        rows[:, k] = np.frombuffer(open_.decompress(blob[at:at + size]), "u1")
        at += size
    return rows.view("<i8")[:, 0]


def joined(*parts: bytes) -> bytes:
    return struct.pack(f"<{len(parts) + 1}I", len(parts), *map(len, parts)) + b"".join(parts)


def parted(blob: bytes) -> list[bytes]:
    n = struct.unpack_from("<I", blob)[0]
    ends = np.cumsum([4 * (n + 1), *struct.unpack_from(f"<{n}I", blob, 4)]).tolist()
    return [blob[a:b] for a, b in zip(ends, ends[1:])]


def changes(values: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before; the first does."""
    out = np.ones(len(values), bool)
    out[1:] = values[1:] != values[:-1]
    return out


def steps(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Differences of values that rise from each start to the next."""
    return np.where(starts, values, np.diff(values, prepend=0))


def unstepped(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total, first = np.cumsum(values), np.flatnonzero(starts)
    return total - np.repeat(total[first] - values[first], np.diff(first, append=len(values)))


def distinct(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of whole numbers, each below 2**32: the place of one of each, in order, and for every place which one it is."""
    n = len(high)
    a, b, c = (int(x).bit_length() for x in (high.max(initial=0), low.max(initial=0), n))
    code = high.astype(np.uint64) << np.uint64(b) | low.astype(np.uint64)
    if a + b + c <= 64:  # numbers alone are sorted several times as fast as their places
        code = code << np.uint64(c) | np.arange(n, dtype=np.uint64)
        code.sort()
        place = (code & np.uint64((1 << c) - 1)).astype(np.int64)
        code >>= np.uint64(c)
    else:
        place = np.argsort(code, kind="stable")
        code = code[place]
    new, at = changes(code), np.empty(n, np.int64)
    at[place] = np.cumsum(new) - 1
    return place[new], at


def discounts(of: np.ndarray) -> np.ndarray:
    """Factor for counts 0 to K + 1 (the last: any larger count), from the number of types seen r times (r up to K + 1).

    A factor that the estimate puts outside (0, 1) is one.
    """
    out = np.ones(K + 2)
    n = of.astype(float)
    if n[1] > 0 and (rest := (K + 1) * n[K + 1] / n[1]) < 1:
        for r in range(1, K + 1):
            if n[r] > 0:
                d = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest)
                if 0 < d < 1:
                    out[r] = d
    return out


@dataclass
class Unigrams:
    """Training tokens, distinct words among them, words seen r times."""

    tokens: int
    types: int
    of: np.ndarray
    documents: int

    def __post_init__(self):
        self.factor = discounts(self.of)
        left = float(((1 - self.factor) * np.arange(K + 2) * self.of)[1:K + 1].sum())
        self.whole = self.tokens if left > 0 else self.tokens + 1
        self.unknown = (left or 1.0) / self.whole

    def chance(self, count: np.ndarray) -> np.ndarray:
        seen = self.factor[np.minimum(count, K + 1)] * count / self.whole
        return np.where(count > 0, seen, self.unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.types + 1)))


def spelled(piece: pa.RecordBatch, groups: int) -> tuple[bytes, list[tuple[int, bytes]]]:
    """A chunk as places among its distinct words, the most frequent first, and for each partition the hashes of its words and their counts in
    training documents."""
    # The same six white space characters and letters A to Z as everywhere; runs of white space leave empty words.
    cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(piece[TEXT], "")))
    words = cut.flatten()
    filled = pc.greater(pc.binary_length(words), 0)
    text = pc.list_parent_indices(cut).filter(filled).to_numpy()
    sizes = np.bincount(text, minlength=len(cut)) + 1
    encoded = words.filter(filled).dictionary_encode()
    names = encoded.dictionary.to_numpy(zero_copy_only=False).tolist()
    tokens = np.full(sizes.sum(), len(names))
    inside = np.ones(len(tokens), bool)
    inside[np.cumsum(sizes) - 1] = False
    tokens[inside] = encoded.indices.to_numpy(zero_copy_only=False)
    often = np.argsort(-np.bincount(tokens, minlength=len(names) + 1), kind="stable")
    tokens = np.argsort(often)[tokens]
    hashes = np.array([*(xxhash.xxh64_intdigest(w, 1) for w in names), END], np.uint64)[often]
    local = np.bincount(tokens[np.repeat(~np.array(piece["held"].to_pylist(), bool), sizes)], minlength=len(hashes))
    group = ((hashes >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    edges = np.flatnonzero(changes(group[order])).tolist()
    parts = [order[a:b] for a, b in zip(edges, [*edges[1:], len(order)])]
    sink = pa.BufferOutputStream()
    rest = piece.select(["key", "held"])
    with pa.ipc.new_stream(sink, rest.schema) as writer:
        writer.write_batch(rest)
    state = joined(squeezed(tokens), squeezed(sizes), squeezed(group), zstandard.ZstdCompressor(level=3).compress(sink.getvalue()))
    return state, [(int(group[p[0]]), joined(hashes[p].astype("<u8").tobytes(), squeezed(local[p]))) for p in parts]


class Words:
    """Tokens of a chunk as places among its words, which are ordered by their numbers; unknown words are one."""

    def __init__(self, state: bytes, replies: dict[int, bytes], groups: int):
        tokens, self.sizes, group = map(unsqueezed, (parts := parted(state))[:3])
        self.piece = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(parts[3])).read_all().combine_chunks()
        got = [tuple(map(unsqueezed, parted(replies[g]))) for g in sorted(replies)]
        number, count = np.empty(len(group), np.int64), np.empty(len(group), np.int64)
        order = np.argsort(group, kind="stable")
        number[order], count[order] = (np.concatenate(x) for x in zip(*got))
        self.numbers, back = np.unique(number, return_inverse=True)
        self.counts = np.zeros(len(self.numbers), np.int64)
        self.counts[back] = count
        self.at = back[tokens]
        self.first = np.cumsum(self.sizes) - self.sizes
        self.trains = np.repeat(~np.array(self.piece["held"].to_pylist(), bool), self.sizes)
        self.groups = groups


class Grams:
    """Distinct n-grams (history, word) of one level of a chunk, ordered by history and word.

    A token's history is the n-gram of the level below at the token before it, so histories are told apart exactly within a chunk. The first
    tokens of a text, before which too few stand, have no n-gram of this level; before the first one stands ``BEGIN``.
    """

    def __init__(self, words: Words, below: Grams | None, seen: np.ndarray, unigrams: Unigrams):
        self.below, self.level = below, 2 if below is None else below.level + 1
        skip = self.level - 2
        place = np.arange(len(words.at)) - np.repeat(words.first, words.sizes)
        self.tokens = np.flatnonzero(place >= skip)
        if below is None:
            history = np.where(place == 0, len(words.numbers), np.roll(words.at, 1))
            self.names, self.seen = np.append(words.numbers, BEGIN)[:, None], np.append(seen, unigrams.documents)
            self.hashes = self.names[:, 0].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        else:
            before = np.full(len(words.at), -1)
            before[below.tokens] = below.at
            history = before[self.tokens - 1]
            self.names, self.seen = np.column_stack([below.names[below.history], words.numbers[below.word]]), seen
            self.hashes = below.gram_hashes
        first, self.at = distinct(history, words.at[self.tokens])
        self.history, self.word, self.first = history[first], words.at[self.tokens][first], self.tokens[first]  # a token of each
        self.local = np.bincount(self.at[words.trains[self.tokens]], minlength=len(first))
        h, w = self.hashes[self.history], words.numbers[self.word].astype(np.uint64)
        mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + w * np.uint64(0xFF51AFD7ED558CCD)
        self.gram_hashes = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        # One partition for each fair share of a quarter of a partition's tokens.
        self.salts = np.maximum(1, self.seen * 4 * words.groups // max(1, unigrams.tokens))
        salt = (w * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % self.salts[self.history].astype(np.uint64)
        group = (((h >> np.uint64(32)) + salt) % np.uint64(words.groups)).astype(np.uint16 if words.groups <= 65536 else np.int64)
        # A history that no training document holds has nothing to tell.
        asked = np.flatnonzero(self.seen[self.history] > 0)
        #: What is sent, partition by partition, ordered by history and word in each; where its histories start; partitions and their starts.
        self.order = asked[np.argsort(group[asked], kind="stable")]
        self.starts = changes(group[self.order]) | changes(self.history[self.order])
        self.edges = np.flatnonzero(changes(group[self.order])).tolist()
        self.groups = group[self.order[self.edges]].tolist()
        self.sent = words.numbers[self.word[self.order]]

    def lower(self, words: Words) -> np.ndarray:
        """Place of each n-gram without its first word: a word, or an n-gram of the level below."""
        if self.below is None:
            return self.word
        at = np.full(len(words.at), -1)
        at[self.below.tokens] = self.below.at
        return at[self.first]

    def blobs(self, below: np.ndarray):
        """(partition, its n-grams); ``below`` has the count on the level below: for pairs of each word, else of each n-gram, which is needed
        only where training documents hold it."""
        for group, a, b in zip(self.groups, self.edges, [*self.edges[1:], len(self.order)]):
            part, starts, word = self.order[a:b], self.starts[a:b], self.sent[a:b]
            history = self.history[part[starts]]
            names, apart, columns = self.names[history], np.arange(len(history)) == 0, []
            for column in names.T:
                columns.append(squeezed(steps(column, apart)))
                apart = apart | changes(column)
            told = below[np.unique(self.word[part])] if self.below is None else below[part][self.local[part] > 0]
            yield group, joined(
                *columns, squeezed(self.salts[history] > 1), squeezed(np.diff(np.flatnonzero(starts), append=len(part))), squeezed(steps(word, starts)),
                squeezed(told), squeezed(self.local[part]))

    def chances(self, replies: dict[int, bytes], below: np.ndarray, lower: np.ndarray, level: Level) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count, probability after its history) of each n-gram, and what each history divides counts by; ``below`` is that of each history
        without its first word, ``lower`` the probability of each n-gram on the level below."""
        n, size = len(self.history), len(self.seen)
        total, times, mass = np.zeros(n, np.int64), np.zeros((size, K)), np.zeros(size)
        history = self.history[self.order]
        for group, a, b in zip(self.groups, self.edges, [*self.edges[1:], len(self.order)]):
            *parts, sums = parted(replies[group])
            mine, seen, wanted = map(unsqueezed, parts)
            total[self.order[a:b]] = mine
            h = history[a:b][self.starts[a:b]]
            times[h] = seen.reshape(K, len(h)).T
            h = h[wanted.astype(bool)]
            mass[h] = np.frombuffer(sums, "<f8") / below[h]
        for h in np.flatnonzero(self.salts > 1).tolist():
            if (whole := level.spread.get(tuple(self.names[h].tolist()))) is not None:
                times[h], mass[h] = whole[:K], whole[K] / below[h]
        left = times @ ((1 - level.factor[1:K + 1]) * np.arange(1, K + 1))
        whole = np.where(left > 0, self.seen, self.seen + 1)
        left = np.where(left > 0, left, 1.0) / np.maximum(whole, 1)
        weight = np.where(self.seen > 0, left / np.maximum(1 - mass, 1e-12), 1.0)
        direct = level.factor[np.minimum(total, K + 1)] * total / np.maximum(whole[self.history], 1)
        return total, np.where(total > 0, direct, weight[self.history] * lower), np.maximum(whole, 1)


def count_words(blobs: list[bytes], group: int, groups: int) -> tuple[list[bytes], bytes]:
    """For each blob the number of each word (small if it is frequent) and its whole count; then tokens, documents, types, and types seen 1 to
    K + 1 times."""
    got = [parted(b) for b in blobs]
    names = [np.frombuffer(g[0], "<u8") for g in got]
    words, at = np.unique(np.concatenate(names), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate([unsqueezed(g[1]) for g in got])).astype(np.int64)
    number = np.empty(len(words), np.int64)
    number[np.argsort(-total, kind="stable")] = 1 + group + groups * np.arange(len(words))
    number[total == 0] = UNKNOWN
    if number.max() >= BEGIN:
        raise ValueError("words are numbered by 32 bits")
    of = np.bincount(np.minimum(total, K + 2), minlength=K + 3)
    stats = np.array([total.sum(), total[words == END].sum(), (total > 0).sum(), *of[1:K + 2]], "<i8")
    return [joined(squeezed(number[x]), squeezed(total[x])) for x in np.split(at, np.cumsum([len(n) for n in names])[:-1])], stats.tobytes()


def count_grams(blobs: list[bytes], level: int, factor: np.ndarray) -> tuple[list[bytes], bytes]:
    """For each blob: counts of its n-grams; per history how many successors were seen r times, and the sum of their discounted counts on the
    level below (by its ``factor``), both only where the blob has an n-gram never seen (else whether there are such successors). Then n-grams
    seen r times, and the same per history that is spread over partitions."""
    names, spread, runs, word, told, local = [], [], [], [], [], []
    for blob in blobs:
        *columns, marks, sizes, next_, below, mine = map(unsqueezed, parted(blob))
        apart, ids = np.arange(len(sizes)) == 0, []
        for column in columns:
            ids.append(unstepped(column, apart))
            apart = apart | changes(ids[-1])
        starts = np.zeros(len(next_), bool)
        starts[np.cumsum(sizes) - sizes] = True
        next_ = unstepped(next_, starts)
        lower = np.zeros(len(next_), np.int64)
        if level == 2:
            lower = below[np.unique(next_, return_inverse=True)[1]]
        else:
            lower[mine > 0] = below
        for all_, x in zip((names, spread, runs, word, told, local), (np.column_stack(ids), marks, sizes, next_, lower, mine)):
            all_.append(x)
    ends = np.cumsum([len(x) for x in runs])[:-1], np.cumsum([len(x) for x in word])[:-1]
    names = np.concatenate(names)  # one after another, so that no two are held twice
    spread = np.concatenate(spread)
    runs = np.concatenate(runs)
    word = np.concatenate(word)
    told = np.concatenate(told)
    local = np.concatenate(local)
    first, history = distinct(np.zeros(len(names), np.int64), names[:, 0])
    for column in names.T[1:]:
        first, history = distinct(history, column)
    names, marked = names[first], spread[first] > 0
    rows = np.repeat(history, runs)
    first, at = distinct(rows, word)
    total = np.bincount(at, weights=local).astype(np.int64)
    below = np.zeros(len(first), np.int64)
    below[at[local > 0]] = told[local > 0]  # alike wherever it was told
    owner, seen = rows[first], total > 0
    of = np.bincount(np.minimum(total, K + 2), minlength=K + 3)[1:K + 2]
    times = np.stack([np.bincount(owner[total == r], minlength=len(names)) for r in range(1, K + 1)], axis=1)
    kept = factor[np.minimum(below, K + 1)] * below
    sums = np.bincount(owner[seen], weights=kept[seen], minlength=len(names))
    replies = []
    for h, size, which in zip(np.split(history, ends[0]), np.split(runs, ends[0]), np.split(at, ends[1])):
        mine = total[which]
        wanted = np.zeros(len(h), bool)
        wanted[np.repeat(np.arange(len(h)), size)[mine == 0]] = True
        # Without an n-gram never seen, a chunk only asks whether a history leaves anything.
        told = np.where(wanted[:, None], times[h], times[h] > 0)
        replies.append(joined(squeezed(mine), squeezed(told.T.ravel()), squeezed(wanted), sums[h][wanted].astype("<f8").tobytes()))
    stats = joined(*(x.tobytes() for x in (of.astype("<i8"), names[marked].astype("<i8"), times[marked].astype("<i8"), sums[marked].astype("<f8"))))
    return replies, stats


@dataclass
class Level:
    """What all partitions of a level said: discount factors, and the histories that are spread over partitions."""

    factor: np.ndarray
    spread: dict[tuple, np.ndarray]


class Ladder:
    """The levels of a chunk, from words up to the n-grams that have been counted: (n-grams, count, probability) each."""

    def __init__(self, words: Words, unigrams: Unigrams):
        self.words, self.unigrams = words, unigrams
        self.grams: Grams | None = None
        self.seen, self.chance = words.counts, unigrams.chance(words.counts)
        #: What counts of the level's n-grams are divided by, for each history.
        self.whole = np.zeros(0)
        #: Probability of every token on the highest level that it has.
        self.tokens = self.chance[words.at]

    def next(self) -> tuple[Grams, np.ndarray]:
        """The n-grams of the level above, and the place of each without its first word."""
        above = Grams(self.words, self.grams, self.seen, self.unigrams)
        return above, above.lower(self.words)

    def blobs(self):
        above, lower = self.next()
        return above.blobs(self.seen if self.grams is None else self.seen[lower])

    def up(self, replies: dict[int, bytes], level: Level) -> None:
        above, lower = self.next()
        below = np.full(len(above.seen), float(self.unigrams.whole)) if self.grams is None else self.whole[self.grams.lower(self.words)]
        self.seen, self.chance, self.whole = above.chances(replies, below, self.chance[lower], level)
        self.grams = above
        self.tokens[above.tokens] = self.chance[above.at]


@contextmanager
def freed_shuffles(spark):
    """Shuffle files go when the query that wrote them ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _replied(table: pa.Table, answers: tuple[list[bytes], bytes], offset: int) -> pa.Table:
    replies, stats = answers
    buckets = [b + offset for b in table["bucket"].to_pylist()]
    return pa.table([pa.array([*buckets, -1], pa.int64()), pa.array([*table["chunk"].to_pylist(), -1], pa.int64()), pa.array([*replies, stats], pa.binary())], NAMES)


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, group: int = GROUP_TOKENS, least: int = LEAST_GROUPS) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) per document; scores are log10 probabilities of the text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[key].dataType.simpleString()
    narrow = docs.select(*dict.fromkeys([key, text]))
    if "Exchange" in narrow._jdf.queryExecution().executedPlan().toString():
        narrow = cut_lineage(narrow)  # it is read twice
    held = F.pmod(F.crc32(F.coalesce(F.col(ROW)[key].cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD
    slim = carried(narrow, text).select(F.col(ROW)[key].alias("key"), TEXT, held.alias("held"))
    size = slim.agg(F.sum(F.octet_length(TEXT))).first()[0] or 0
    groups = max(least, -(-size // (6 * group)))

    def cut(batches):
        """Chunks may join what several batches hold."""
        from pyspark import TaskContext

        chunk, kept, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for piece in chunks([batch], TEXT, CHUNK_BYTES):
                more = piece[TEXT].nbytes
                if kept and size + more > CHUNK_BYTES:
                    yield chunk, pa.concat_batches(kept)
                    chunk, kept, size = chunk + 1, [], 0
                kept.append(piece)
                size += more
        if kept:
            yield chunk, pa.concat_batches(kept)

    def words_sent(batches):
        for chunk, piece in cut(batches):
            state, sent = spelled(piece, groups)
            # The chunk itself is a bucket of its own, which is handed on.
            made = [(-2 - chunk, state), *sent]
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int64()), pa.array([chunk] * len(made), pa.int64()), pa.array([m[1] for m in made], pa.binary())], NAMES)

    def words_counted(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        return table if bucket < 0 else _replied(table, count_words(table["blob"].to_pylist(), bucket, groups), 0)

    with freed_shuffles(spark):
        replies = cut_lineage(slim.mapInArrow(words_sent, SCHEMA).groupBy("bucket").applyInArrow(words_counted, SCHEMA))
    # One row of K + 4 numbers for each partition.
    rows = [np.frombuffer(r[0], "<i8") for r in replies.where("chunk = -1").select("blob").collect()]
    sums = np.sum(rows, axis=0) if rows else np.zeros(K + 4, np.int64)
    unigrams = Unigrams(int(sums[0]), int(sums[2]), np.concatenate([[0], sums[3:]]), int(sums[1]))
    replies, levels = replies.where("chunk >= 0"), []

    def reopened(table: pa.Table) -> Ladder:
        """A chunk with all levels that have been counted."""
        blobs = dict(zip(table["bucket"].to_pylist(), table["blob"].to_pylist()))
        state = blobs.pop(-2 - table["chunk"][0].as_py())
        said = lambda n: {b % groups: v for b, v in blobs.items() if b // groups == n}
        ladder = Ladder(Words(state, said(0), groups), unigrams)
        for n, level in enumerate(levels, 1):
            ladder.up(said(n), level)
        return ladder

    for n in range(2, order + 1):

        def grams_sent(table: pa.Table) -> pa.Table:
            chunk = table["chunk"][0].as_py()
            made = list(reopened(table).blobs())
            return pa.table([pa.array([m[0] for m in made], pa.int64()), pa.array([chunk] * len(made), pa.int64()), pa.array([m[1] for m in made], pa.binary())], NAMES)

        def grams_counted(table: pa.Table) -> pa.Table:
            factor = levels[-1].factor if levels else unigrams.factor
            return _replied(table, count_grams(table["blob"].to_pylist(), n, factor), groups * (n - 1))

        with freed_shuffles(spark):
            counted = cut_lineage(replies.groupBy("chunk").applyInArrow(grams_sent, SCHEMA).groupBy("bucket").applyInArrow(grams_counted, SCHEMA))
        of, spread = np.zeros(K + 2, np.int64), {}
        # One row for each partition; spread histories are at most four for each.
        for (blob,) in counted.where("chunk = -1").select("blob").collect():
            times_seen, names, times, mass = (np.frombuffer(x, k) for x, k in zip(parted(blob), ("<i8", "<i8", "<i8", "<f8")))
            of[1:] += times_seen
            for h, t, m in zip(names.reshape(-1, n - 1).tolist(), times.reshape(-1, K), mass.tolist()):
                spread[tuple(h)] = spread.get(tuple(h), np.zeros(K + 1)) + np.append(t, m)
        levels = [*levels, Level(discounts(of), spread)]
        replies = replies.union(counted.where("chunk >= 0"))

    def scored(table: pa.Table) -> pa.Table:
        ladder = reopened(table)
        words = ladder.words
        seen = words.counts[words.at]
        add = lambda x: pa.array(np.add.reduceat(x, words.first))
        return pa.table([
            words.piece["key"], words.piece["held"], pa.array(words.sizes), add((seen > 0).astype(np.int64)), pa.array(np.full(len(words.sizes), unigrams.tokens)),
            add(unigrams.base(seen)), add(np.log10(ladder.tokens))], [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return replies.groupBy("chunk").applyInArrow(
        scored, f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
