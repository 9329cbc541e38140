"""Substring de-duplication by suffix trees over groups of word suffixes.

A suffix starts at every word that has a window of words from it on. A text loses the words under every window whose words started
earlier too; those windows are the internal nodes of depth ``window`` of the suffix tree of all texts, so suffixes are kept to that
depth. Three steps, between which documents travel in chunks, as codes of the chunk's own words:

1. Filter. A suffix whose window hash occurs once has no such node above it. A chunk sends the short hashes of its distinct windows,
   and hears which of them other chunks have as well. Equal windows always meet; windows that differ may, which step 2 settles.
2. Trees. The suffixes left are dealt into groups by a prefix: one word, or 2, 5 or all words of the window where the shorter prefix
   holds more suffixes than fit one task (counted beforehand over all documents); small prefixes share a group. The prefix is that of
   the window's anchor, the word in it from which five words have the least hash: neighbouring suffixes mostly have the same anchor, so
   they go to one group as one stretch of words, and equal windows have equal anchors. A group orders its suffixes and takes the common
   prefix lengths of neighbours: runs of length ``window`` are the deep nodes. All suffixes below a node but the earliest are late.
3. Marks. Late suffixes go back to their chunk, which removes the words under them. Documents without any suffix left after the
   filter have their result by then and only pass.

Words decide: windows that hash alike but differ are told apart, in a chunk and in a group. A window that repeats inside a chunk is
sent once, its later places are marked on the spot, so a passage that a third of all documents share is one entry per chunk.

Order is by id (null first), then place in the input. Null texts have no words. Texts shorter than a window keep all words.
Repeated rows are documents of their own, of which all but the first lose whatever windows they have. An empty table gives an empty
result. A chunk is about 4 MB of text or one longer text, which one task holds whole.
"""

from __future__ import annotations

import hashlib
import struct
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from millrace.llm.common import NULL_ID, ROW, TEXT, bounded_batches, carried, chunks, listed, numbered, received, shared_value

WINDOW = 20
#: Lengths of the prefixes that split suffixes into groups; the window's length comes last.
PREFIXES = (1, 2, 5)
#: Suffixes that one task orders at once (about 300 MB there, if all pass the filter), and the least number of groups.
GROUP_SUFFIXES, LEAST_GROUPS = 2_000_000, 64
SLOTS = 1 << 14
#: Suffixes that are turned into sort keys, or compared, at once.
ROWS = 1 << 14
#: Bits of the hash that the filter compares within one of its groups.
FILTER_BITS = 32
FACTOR = 0xD6E8FEB86659FD93


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of integers, each in as few bytes as its largest value needs, compressed byte by byte place."""
    head, body = [], []
    for a in arrays:
        a = a.astype(np.int64).view(np.uint64)
        top = int(a.max()) if len(a) else 0
        width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
        head.append(struct.pack("<IB", len(a), width))
        body.append(a.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes())
    return b"".join(head) + zstandard.ZstdCompressor(level=3).compress(b"".join(body))


def unpacked(blob: bytes, n: int) -> list[np.ndarray]:
    sizes = [struct.unpack_from("<IB", blob, 5 * i) for i in range(n)]
    body, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[5 * n:]), np.uint8), 0, []
    for size, width in sizes:
        planes = body[at:at + size * width].reshape(width, size).T
        out.append(np.ascontiguousarray(planes).view(f"<u{width}").ravel().astype(np.uint64).view(np.int64))
        at += size * width
    return out


def framed(*blobs: bytes) -> bytes:
    return struct.pack(f"<{len(blobs)}I", *map(len, blobs)) + b"".join(blobs)


def unframed(blob: bytes, n: int) -> list[bytes]:
    ends = np.cumsum([4 * n, *struct.unpack_from(f"<{n}I", blob)])
    return [blob[a:b] for a, b in zip(ends[:-1], ends[1:])]


def steps(values: np.ndarray) -> np.ndarray:
    """Differences that ``np.cumsum`` undoes."""
    return np.diff(values, prepend=values.dtype.type(0))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by a plain sort: ``np.unique`` hashes them, which takes many times as long."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])[:len(values)]]


def rolled(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``size`` values from each place on, by doubling."""
    if size == 1:
        return values
    half = rolled(values, size // 2)
    n, step = max(0, len(values) - size + 1), size // 2
    out = half[:n] * np.uint64(pow(FACTOR, step, 1 << 64)) + half[step:step + n]
    return out * np.uint64(FACTOR) + values[size - 1:size - 1 + n] if size % 2 else out


def least_places(values: np.ndarray, size: int) -> np.ndarray:
    """Place of the least of ``size`` values from each place on; the first of equal ones."""
    least, have = (values >> np.uint64(32) << np.uint64(32)) | np.arange(len(values), dtype=np.uint64), 1
    while 2 * have <= size:
        least, have = np.minimum(least[:-have], least[have:]), 2 * have
    if size > have:
        least = np.minimum(least[:have - size], least[size - have:])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Words:
    """Words of documents, in order of (id, place in the input), as codes of their vocabulary (commonest first)."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, vocabulary: list[bytes], codes: np.ndarray):
        self.keys, self.counts, self.vocabulary, self.codes = keys, counts, vocabulary, codes
        self.base = np.cumsum(counts) - counts

    @classmethod
    def read(cls, keys: np.ndarray, texts: pa.Array) -> Words:
        order = np.argsort(keys, kind="stable")
        ids, counts, names = numbered(pc.fill_null(texts, "").take(pa.array(order)))
        ranks = np.argsort(-np.bincount(ids, minlength=len(names)), kind="stable")
        code = np.zeros(len(names), np.int64)
        code[ranks] = np.arange(len(ranks))
        return cls(keys[order], counts, listed(names.take(pa.array(ranks))), code[ids])

    def pack(self) -> bytes:
        names = zstandard.ZstdCompressor(level=3).compress(b"\n".join(self.vocabulary))
        return framed(names, packed(steps(self.keys), self.counts, self.codes))

    @classmethod
    def unpack(cls, blob: bytes) -> Words:
        names, rest = unframed(blob, 2)
        keys, counts, codes = unpacked(rest, 3)
        return cls(np.cumsum(keys), counts, zstandard.ZstdDecompressor().decompress(names).split(), codes)

    def hashes(self) -> np.ndarray:
        table = np.fromiter(map(xxhash.xxh64_intdigest, self.vocabulary, repeat(1)), np.uint64, len(self.vocabulary))
        return table[self.codes]

    def starts(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Places at which a window starts, and the document of each."""
        fit = np.maximum(self.counts - window + 1, 0)
        doc = np.repeat(np.arange(len(self.counts)), fit)
        return np.arange(len(doc)) + np.repeat(self.base - (np.cumsum(fit) - fit), fit), doc

    def of(self, docs: np.ndarray) -> Words:
        """The documents that ``docs`` marks, with the words that they use."""
        codes = self.codes[np.repeat(docs, self.counts)]
        used = np.flatnonzero(np.bincount(codes, minlength=len(self.vocabulary)))
        code = np.zeros(len(self.vocabulary), np.int64)
        code[used] = np.arange(len(used))
        return Words(self.keys[docs], self.counts[docs], [self.vocabulary[i] for i in used.tolist()], code[codes])

    def results(self, gone: np.ndarray | None, texts: bool) -> pa.Table:
        names, rows = np.array([*self.vocabulary, b""], object)[:-1], []
        for at, n in zip(self.base.tolist(), self.counts.tolist()):
            codes = self.codes[at:at + n]
            out = np.zeros(n, bool) if gone is None else gone[at:at + n]
            kept = b" ".join(names[codes[~out]].tolist())
            row = (n, int(out.sum()), hashlib.sha256(kept).hexdigest())
            if texts:
                turns = np.flatnonzero(np.diff(np.concatenate([[0], out.astype(np.int8), [0]])))
                row += (kept.decode(), [[int(a), int(b - a)] for a, b in zip(turns[::2], turns[1::2])])
            rows.append(row)
        kinds = [pa.int64(), pa.int64(), pa.string(), *([pa.string(), pa.list_(pa.list_(pa.int64()))] if texts else [])]
        columns = list(zip(*rows)) if rows else [[] for _ in kinds]
        keys = pa.array(self.keys, mask=self.keys == NULL_ID)
        return pa.table([keys, *[pa.array(c, k) for c, k in zip(columns, kinds)]], [f"c{i}" for i in range(len(kinds) + 1)])


class Prefixes:
    """Prefix slots of suffixes by prefix length, and the group of each suffix."""

    def __init__(self, window: int):
        self.lengths = [*[n for n in PREFIXES if n < window], window]

    def slots(self, hashes: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """Mixed hash of the anchor's prefix of each length, at last of the window; its lowest bits are the slot."""
        if not len(at):
            return [np.zeros(0, np.uint64) for _ in self.lengths]
        *short, window = self.lengths
        longest = max(short, default=window)
        anchor = least_places(_mixed(rolled(hashes, longest)), window - longest + 1)[at]
        return [*[_mixed(rolled(hashes, n))[anchor] for n in short], _mixed(rolled(hashes, window))[at]]

    def plan(self, counts: np.ndarray, group: int, least: int) -> None:
        """``counts``: suffixes by (length, slot). A slot holds a group, shares one, or is left to the next length; at the last
        length it is split by the whole window."""
        total = int(counts[0].sum())
        group = max(1, min(group, -(-total // least)))
        self.filters = max(1, -(-total // group))
        self.base = np.full(counts.shape, -1, np.int64)
        self.parts = np.ones(SLOTS, np.uint64)
        at = 0
        for level, row in enumerate(counts):
            filled = 0
            for slot, n in enumerate(row.tolist()):
                if n <= group:
                    if filled + n > group:
                        at, filled = at + 1, 0
                    self.base[level, slot], filled = at, filled + n
            at += 1
        for slot in np.flatnonzero(self.base[-1] < 0).tolist():
            self.base[-1, slot], self.parts[slot] = at, -(-int(counts[-1, slot]) // group)
            at += int(self.parts[slot])

    def groups(self, slots: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(slots[0]), -1, np.int64)
        for base, prefix in zip(self.base, slots):
            out = np.where(out < 0, base[(prefix % np.uint64(SLOTS)).astype(np.int64)], out)
        last = slots[-1] % np.uint64(SLOTS)
        split = (out == self.base[-1][last.astype(np.int64)]) * (slots[-1] // np.uint64(SLOTS) % self.parts[last.astype(np.int64)])
        return out + split.astype(np.int64)

    def names(self, deep: np.ndarray, bits: int) -> np.ndarray:
        """(filter group, short hash) of each window as one number."""
        return (deep % np.uint64(self.filters) << np.uint64(32)) | (deep >> np.uint64(64 - bits))


def shared_names(blobs: list[bytes]) -> list[np.ndarray]:
    """Which entries of each blob another blob has too; entries are distinct within a blob."""
    parts = [np.cumsum(unpacked(b, 1)[0]) for b in blobs]
    names = np.concatenate(parts)
    order = np.argsort(names)
    same = names[order][1:] == names[order][:-1]
    out = np.zeros(len(names), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return np.split(out, np.cumsum([len(p) for p in parts])[:-1])


def stretches(at: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words under the windows that start at ``at``, and where each window starts among these words."""
    cut = np.concatenate([[True], (np.diff(at) >= window) | (np.diff(doc) != 0)])
    first = np.flatnonzero(cut)
    begin, of = at[first], np.cumsum(cut) - 1
    sizes = at[np.append(first[1:], len(at)) - 1] + window - begin
    shift = np.cumsum(sizes) - sizes - begin
    return np.arange(sizes.sum()) - np.repeat(shift, sizes), at + shift[of]


def suffix_blob(words: Words, at: np.ndarray, doc: np.ndarray, window: int) -> bytes:
    """Suffixes by place, with the ids of their documents and their words, each word once."""
    held = words.codes[stretches(at, doc, window)[0]]
    used = distinct(held)
    names = zstandard.ZstdCompressor(level=3).compress(b"\n".join([words.vocabulary[i] for i in used.tolist()]))
    first = np.append(True, doc[1:] != doc[:-1])
    return framed(names, packed(steps(at), steps(np.cumsum(first) - 1), steps(words.keys[doc[first]]), np.searchsorted(used, held)))


def tree_order(paths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their words, and how many leading words each shares with the one before it."""
    bits = max(1, (size - 1).bit_length())
    each, (n, width) = max(1, 63 // bits), paths.shape
    parts = np.zeros((-(-width // each), n), np.int64)
    for a in range(0, n, ROWS):
        for k, column in enumerate(paths[a:a + ROWS].T):
            part = parts[k // each, a:a + ROWS]
            part[:] = part << bits | column
    order = np.argsort(parts[0])
    alike = np.append(False, np.diff(parts[0][order]) == 0)[:n]  # as the one before, as far as they are ordered
    for part in parts[1:]:
        at = np.flatnonzero(alike | np.append(alike[1:], False)[:n])
        run, value = np.cumsum(~alike[at]), part[order[at]]
        differ = alike[at] & np.append(False, value[1:] != value[:-1])[:len(at)]
        mixed = np.zeros(len(at) + 1, bool)
        mixed[run[differ]] = True
        again = np.flatnonzero(mixed[run])  # other runs are in order as they are
        by = again[np.lexsort((value[again], run[again]))]
        order[at[again]], value[again] = order[at[by]], value[by]
        alike[at] &= np.append(False, value[1:] == value[:-1])[:len(at)]
    depth = np.zeros(n, np.int64)
    for a in range(1, n, ROWS):
        rows = paths[order[a - 1:a + ROWS]]
        same = rows[1:] == rows[:-1]
        depth[a:a + ROWS] = np.where(same.all(axis=1), width, same.argmin(axis=1))
    return order, depth


def late_suffixes(blobs: list[bytes], places: np.ndarray, window: int) -> list[np.ndarray]:
    """Places of the suffixes of each blob that are not the earliest below their node of depth ``window``;
    ``places`` orders blobs alike in id."""
    names, numbers = zip(*[unframed(b, 2) for b in blobs])
    names = [zstandard.ZstdDecompressor().decompress(x) for x in names]
    found, counts, known = numbered(pa.array(names, pa.large_binary()).view(pa.large_string()))
    starts, keys, paths = [], [], []
    for blob, table in zip(numbers, np.split(found.astype(np.int32), np.cumsum(counts)[:-1])):
        at, of, ids, codes = unpacked(blob, 4)
        at, of = np.cumsum(at), np.cumsum(of)
        starts.append(at)
        keys.append(np.cumsum(ids)[of])
        paths.append(np.lib.stride_tricks.sliding_window_view(table[codes], window)[stretches(at, of, window)[1]])
    sizes = [len(s) for s in starts]
    order, depth = tree_order(np.concatenate(paths), len(known))
    top = depth < window
    first, node = np.flatnonzero(top), np.cumsum(top) - 1
    early = np.ones(len(order), bool)  # the least (id, place of the blob, place) below each node
    for values in (np.concatenate(keys), np.repeat(places, sizes), np.concatenate(starts)):
        values = np.where(early, values[order], np.iinfo(np.int64).max)
        early &= values == np.minimum.reduceat(values, first)[node]
    late = np.zeros(len(order), bool)
    late[order] = ~early
    return [s[m] for s, m in zip(starts, np.split(late, np.cumsum(sizes)[:-1]))]


def deduplicated(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, texts: bool = False,
    group: int = GROUP_SUFFIXES, least: int = LEAST_GROUPS, filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) per document; with ``texts`` also kept_text and spans, the
    stretches removed as [first word, words]; late windows that touch or overlap are one stretch. Keys must be integers."""
    spark = docs.sparkSession
    bounded_batches(spark)
    slim = carried(docs.select(*dict.fromkeys([key, text])), text).select(F.col(ROW)[key].cast("long").alias("key"), TEXT)
    prefixes = Prefixes(window)

    def opened(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in chunks([batch], TEXT):
                yield chunk, Words.read(piece["key"].fill_null(NULL_ID).to_numpy(zero_copy_only=False), piece[TEXT])
                chunk += 1

    def counted(batches):
        total = np.zeros((len(prefixes.lengths), SLOTS), np.int64)
        for _, found in opened(batches):
            for level, slots in enumerate(prefixes.slots(found.hashes(), found.starts(window)[0])):
                total[level] += np.bincount((slots % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["slot", "n"])

    sizes = slim.mapInArrow(counted, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # a row per slot
    counts = np.zeros((len(prefixes.lengths), SLOTS), np.int64)
    counts.ravel()[sizes["slot"].to_numpy(np.int64)] = sizes["n"].to_numpy(np.int64)
    prefixes.plan(counts, group, least)
    plan = shared_value(spark, prefixes)
    names, schema = ["bucket", "chunk", "blob"], "bucket long, chunk long, blob binary"
    table_of = lambda rows, kind=pa.table: kind(
        [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[], [], []], [pa.int64(), pa.int64(), pa.binary()])], names)

    def named(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        deep = rolled(hashes, window)
        return received(plan).names(_mixed(deep[at]), filter_bits) if len(at) else np.zeros(0, np.uint64)

    def sent(batches):
        for chunk, words in opened(batches):
            windows = distinct(named(words.hashes(), words.starts(window)[0]))
            groups = (windows >> np.uint64(32)).astype(np.int64)
            edges = np.flatnonzero(np.diff(groups, prepend=-1))
            rows = [(-1 - chunk, chunk, words.pack())]
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(groups)]):
                rows.append((int(groups[a]), chunk, packed(steps((windows[a:b] & np.uint64(0xFFFFFFFF)).astype(np.int64)))))
            yield table_of(rows, pa.RecordBatch.from_arrays)

    def filtered(table: pa.Table) -> pa.Table:
        if table["bucket"][0].as_py() < 0:
            return table
        marks = shared_names(table["blob"].to_pylist())
        rows = zip(table["bucket"].to_pylist(), table["chunk"].to_pylist(), marks)
        return table_of([(b, c, packed(steps(np.flatnonzero(m)))) for b, c, m in rows if m.any()])

    def suffixes(table: pa.Table) -> pa.Table:
        blobs = dict(zip(table["bucket"].to_pylist(), table["blob"].to_pylist()))
        whole = min(blobs)
        words = Words.unpack(blobs.pop(whole))
        at, doc = words.starts(window)
        hashes = words.hashes()
        windows = named(hashes, at)
        by = np.argsort(windows)
        edge = np.flatnonzero(np.append(True, np.diff(windows[by]) != 0)[:len(at)])
        first, same = np.minimum.reduceat(by, edge) if len(at) else by, np.zeros(len(at), np.int64)
        same[by] = np.repeat(np.arange(len(edge)), np.diff(edge, append=len(at)))
        held = np.zeros(len(edge), bool)
        edges = (windows[first] >> np.uint64(32)).astype(np.int64)
        for bucket, marks in blobs.items():
            held[np.searchsorted(edges, bucket) + np.cumsum(unpacked(marks, 1)[0])] = True
        again = np.flatnonzero(first[same] != np.arange(len(at)))
        mine = np.ones(len(again), bool)  # places whose words are those of the first place with that hash
        for k in range(window):
            mine &= words.codes[at[again] + k] == words.codes[at[first[same[again]]] + k]
        stray = again[~mine]
        held[same[stray]] = True
        out = np.zeros(len(at), bool)
        out[first[held]] = True
        out[stray] = True
        touched = np.zeros(len(words.counts), bool)
        touched[doc[out]] = touched[doc[again]] = True
        done, rest = words.of(~touched), words.of(touched)
        sink = pa.BufferOutputStream()
        result = done.results(None, texts)
        with pa.ipc.new_stream(sink, result.schema) as writer:
            writer.write_table(result)
        chunk = -1 - whole
        moved = np.cumsum(np.where(touched, words.counts, 0)) - words.counts - words.base
        local = (at + moved[doc])[again[mine]]
        done_blob = zstandard.ZstdCompressor(level=3).compress(sink.getvalue())
        rows = [(whole, chunk, framed(done_blob, packed(steps(local)), rest.pack()))]
        sends, of = (at + moved[doc])[out], (np.cumsum(touched) - 1)[doc[out]]
        if len(sends):
            groups = received(plan).groups(prefixes.slots(hashes[np.repeat(touched, words.counts)], sends))
            by = np.argsort(groups, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(groups[by])) + 1):
                rows.append((int(groups[part[0]]), chunk, suffix_blob(rest, sends[part], of[part], window)))
        return table_of(rows)

    def rooted(table: pa.Table) -> pa.Table:
        if table["bucket"][0].as_py() < 0:
            return table
        late = late_suffixes(table["blob"].to_pylist(), table["chunk"].to_numpy(), window)
        rows = zip(table["bucket"].to_pylist(), table["chunk"].to_pylist(), late)
        return table_of([(b, c, packed(steps(at))) for b, c, at in rows if len(at)])

    extra = ["kept_text", "spans"] if texts else []

    def applied(table: pa.Table) -> pa.Table:
        blobs = dict(zip(table["bucket"].to_pylist(), table["blob"].to_pylist()))
        done, local, rest = unframed(blobs.pop(min(blobs)), 3)
        words = Words.unpack(rest)
        late = np.concatenate([np.cumsum(unpacked(b, 1)[0]) for b in [local, *blobs.values()]])
        cover = np.zeros(len(words.codes) + window + 1, np.int64)
        np.add.at(cover, late, 1)
        np.add.at(cover, late + window, -1)
        found = words.results(np.cumsum(cover)[:len(words.codes)] > 0, texts)
        before = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(done)).read_all()
        return pa.concat_tables([before, found]).rename_columns([key, "n_words", "n_removed", "kept_sha256", *extra])

    more = ", kept_text string, spans array<array<long>>" if texts else ""
    shared = slim.mapInArrow(sent, schema).groupBy("bucket").applyInArrow(filtered, schema)
    trees = shared.groupBy("chunk").applyInArrow(suffixes, schema).groupBy("bucket").applyInArrow(rooted, schema)
    return trees.groupBy("chunk").applyInArrow(applied, f"`{key}` long, n_words long, n_removed long, kept_sha256 string{more}")
