"""SimHash near-duplicates through a Gray-order hierarchical index.

Distinct fingerprints are sorted by Gray rank, so that neighbours share most bits, and cut into leaves. A node keeps the bits
that all below it share (mask and pattern): two nodes whose patterns differ in more shared bits than allowed hold no link, and
the whole pair is pruned. Leaf nodes travel with groups of leaves above them as upper nodes; pairs of leaves that survive meet in
one row each, are pruned again by nodes of ``NODE`` fingerprints inside, and what is left is compared bit for bit.

A leaf holds about twice the square root of all distinct fingerprints, so leaves, and the node table sent to every task (24
bytes a leaf), both grow with the square root only: 10 billion fingerprints make 50,000 leaves. A pair of leaves returns a
spanning forest of its links, never all pairs, so a family of thousands of near copies stays linear in what it emits.

Hashes are folded into 64 counters a text by slices, so a task holds the text itself and little more, however long it is.

Copies of a text share a fingerprint and are one entry of the index. Null and empty texts have fingerprint zero and are linked
like any other. A null id is never the smallest of its group unless the group has no other. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from millrace.llm.common import NULL_ID, ROW, TEXT, bounded_batches, carried, chunks
from millrace.llm.links import components
from millrace.session import cut_lineage

SHINGLE, DISTANCE, SEED = 3, 2, 42
NODE, GROUP = 32, 32
LEAST_LEAF = 256
#: Bytes of text whose words, and hashes whose bits, a Python task holds at once.
SLICE_BYTES, HASHES_HELD = 1 << 16, 1 << 14
GAP_BYTE = re.compile(rb"[\x20\x09-\x0D]")


def _slices(data: bytes, shingle: int):
    """Words of a text by slices of ``SLICE_BYTES``, each led by the last words of the one before, so that every shingle is in one."""
    found, at = [], 0
    while at < len(data):
        stop = GAP_BYTE.search(data, at + SLICE_BYTES) if at + SLICE_BYTES < len(data) else None
        stop = stop.start() if stop else len(data)
        found = found[max(0, len(found) - shingle + 1):] + data[at:stop].lower().split()  # bytes: only ASCII is lower-cased and splits
        at = stop
        yield found


def fingerprint_values(texts: list[str | None], shingle: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprints: a bit is set if it is set in over half of the hashes of the text's word shingles.

    Only 64 counters a text and the hashes of one slice are held, however long the texts are.
    """
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    hashes: list[int] = []
    owners: list[int] = []
    sizes: list[int] = []

    def fold():
        if hashes:
            bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            starts = np.cumsum([0, *sizes[:-1]])
            np.add.at(ones, owners, np.add.reduceat(bits, starts, axis=0, dtype=np.int64))
            np.add.at(n, owners, sizes)
            hashes.clear(), owners.clear(), sizes.clear()

    for i, text in enumerate(texts):
        made = 0
        for found in _slices((text or "").encode(), shingle):
            if len(found) >= shingle:
                joined = b" ".join(found)
                ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
                starts = [0, *ends[:len(found) - shingle].tolist()]
                hashes += [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist())]
                owners.append(i), sizes.append(len(starts))
                made += len(starts)
                if len(hashes) >= HASHES_HELD:
                    fold()
        if text and not made and found:
            hashes.append(digest(b" ".join(found), SEED))
            owners.append(i), sizes.append(1)
    fold()
    return np.packbits(ones * 2 > n[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(key, fp, text_hash) per row."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType
    slim = carried(docs.select(*dict.fromkeys([key, text])), text).select(
        F.col(ROW)[key].alias(key), F.col(TEXT), F.xxhash64(TEXT).alias("text_hash"))

    def run(batches):
        for batch in batches:
            for part in chunks([batch], TEXT, 1_000_000):
                values = fingerprint_values(part[TEXT].to_pylist(), shingle)
                yield pa.RecordBatch.from_arrays([part[key], pa.array(values.view(np.int64)), part["text_hash"]], [key, "fp", "text_hash"])

    return slim.mapInArrow(run, f"`{key}` {kind.simpleString()}, fp long, text_hash long")


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each fingerprint in Gray order."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def shared(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Mask and pattern of the bits shared by each run of ``size`` values."""
    at = np.arange(0, len(values), size)
    ones, some = np.bitwise_and.reduceat(values, at), np.bitwise_or.reduceat(values, at)
    mask = ~(ones ^ some)
    return mask, ones & mask


def _upper(masks: np.ndarray, patterns: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for runs of ``size`` nodes."""
    at = np.arange(0, len(masks), size)
    mask = np.bitwise_and.reduceat(masks, at)
    mask &= ~(np.bitwise_and.reduceat(patterns, at) ^ np.bitwise_or.reduceat(patterns, at))
    return mask, patterns[at] & mask


def _near(ma, pa_, mb, pb, distance: int):
    return np.bitwise_count((pa_ ^ pb) & ma & mb) <= distance


def forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest index of each node's component."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        open_ = a != b
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def linked(a: np.ndarray, b: np.ndarray | None, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (value, root value), of the links between two Gray-ordered leaves or inside one (``b`` is None)."""
    other = a if b is None else b
    (ma, pa_), (mb, pb) = shared(a, NODE), shared(other, NODE)
    i, j = np.nonzero(_near(ma[:, None], pa_[:, None], mb[None], pb[None], distance))
    if b is None:
        i, j = i[j >= i], j[j >= i]
    at = np.arange(NODE)
    base = 0 if b is None else len(a)
    u, v, n = [], [], len(a) + (0 if b is None else len(b))
    kept = np.arange(n)
    for s in range(0, len(i), 512):
        x = np.minimum(i[s:s + 512, None] * NODE + at, len(a) - 1)
        y = np.minimum(j[s:s + 512, None] * NODE + at, len(other) - 1)
        k, p, q = np.nonzero(np.bitwise_count(a[x][:, :, None] ^ other[y][:, None, :]) <= distance)
        u.append(x[k, p])
        v.append(y[k, q] + base)
        if sum(map(len, u)) > 1 << 20:  # fold what was found, so that dense leaves stay small
            kept = forest(n, np.concatenate([np.arange(n), *u]), np.concatenate([kept, *v]))
            u, v = [], []
    root = forest(n, np.concatenate([np.arange(n), *u]).astype(np.int64), np.concatenate([kept, *v]).astype(np.int64))
    every = a if b is None else np.concatenate([a, b])
    node = np.nonzero(root != np.arange(n))[0]
    return every[node], every[root[node]]


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(u, v): links that connect whatever is connected among the distinct fingerprints ``fp``."""
    spark = distinct.sparkSession
    size = max(LEAST_LEAF, 2 * math.isqrt(distinct.count()))
    rank = F.col("fp")
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    order = distinct.select("fp", rank.bitwiseXOR(F.lit(NULL_ID)).alias("place"))

    def leaves(batches):
        from pyspark import TaskContext

        part, held, n = TaskContext.get().partitionId(), [], 0

        def leaf(values):
            nonlocal n
            mask, pattern = shared(values, len(values))
            n += 1
            return pa.RecordBatch.from_arrays([
                pa.array([(part << 32) + n - 1]), pa.array(mask.view(np.int64)), pa.array(pattern.view(np.int64)),
                pa.array([values.tobytes()], pa.binary())], ["leaf", "mask", "pattern", "members"])

        for batch in batches:
            held = np.concatenate([*([held] if len(held) else []), batch["fp"].to_numpy().view(np.uint64)])
            while len(held) >= size:
                yield leaf(held[:size])
                held = held[size:]
        if len(held):
            yield leaf(held)

    table = cut_lineage(order.repartitionByRange("place").sortWithinPartitions("place").select("fp").mapInArrow(
        leaves, "leaf long, mask long, pattern long, members binary"))
    # 24 bytes a leaf, of which there are about half the square root of the fingerprints.
    nodes = np.array([tuple(r) for r in table.select("leaf", "mask", "pattern").orderBy("leaf").collect()], np.int64).reshape(-1, 3)
    sent = spark.sparkContext.broadcast(nodes)

    def routed(batches):
        nodes = sent.value
        masks, patterns = nodes[:, 1].copy().view(np.uint64), nodes[:, 2].copy().view(np.uint64)
        upper = _upper(masks, patterns, GROUP)
        for batch in batches:
            for leaf, mask, pattern, members in zip(*[batch[c].to_pylist() for c in ("leaf", "mask", "pattern", "members")]):
                m, p = np.uint64(mask & (1 << 64) - 1), np.uint64(pattern & (1 << 64) - 1)
                groups = np.nonzero(_near(m, p, *upper, distance))[0]
                at = (groups[:, None] * GROUP + np.arange(GROUP)).ravel()
                at = at[at < len(nodes)]
                at = at[_near(m, p, masks[at], patterns[at], distance) & (nodes[at, 0] >= leaf)]
                for to in nodes[at, 0].tolist():
                    yield pa.RecordBatch.from_arrays([
                        pa.array([to]), pa.array([leaf]), pa.array([members], pa.binary())], ["target", "source", "others"])

    def compared(batches):
        for batch in batches:
            for target, source, others, members in zip(*[batch[c].to_pylist() for c in ("target", "source", "others", "members")]):
                a = np.frombuffer(others, np.uint64)
                u, v = linked(a, None if target == source else np.frombuffer(members, np.uint64), distance)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    pairs = table.mapInArrow(routed, "target long, source long, others binary")
    met = pairs.join(table.select("leaf", "members"), F.col("target") == F.col("leaf"))
    return met.select("target", "source", "others", "members").mapInArrow(compared, "u long, v long")


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(key, fp, text_hash, component_id) per row; the component's id is the smallest key reachable over links."""
    table = cut_lineage(fingerprints(docs, key, text, shingle))
    distinct = cut_lineage(table.groupBy("fp").agg(F.min(key).alias("_llm_first")))
    found = components(links(distinct, distance))
    rooted = distinct.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", "_llm_first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("_llm_first").alias("component_id"))
    named = rooted.select(F.col("fp").alias("_llm_fp"), "root").join(least, "root").select("_llm_fp", "component_id")
    return table.join(named, F.col("fp") == F.col("_llm_fp")).drop("_llm_fp")


def dedupe(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One document of each group: the one with the smallest key (of rows alike in key, the smallest text hash), all columns."""
    table = grouped(docs, key, text, shingle, distance)
    order = F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.col("text_hash").alias("h"))
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp"), F.col("fp")))
    chosen = table.groupBy(group.alias("_llm_g")).agg(F.min(order).alias("_llm_o")).select(
        F.coalesce(F.col("_llm_o.k").cast("string"), F.lit("null")).alias("_llm_k"), F.col("_llm_o.h").alias("_llm_h"))
    rows = carried(docs, text).select(
        ROW, F.coalesce(F.col(ROW)[key].cast("string"), F.lit("null")).alias("_llm_k"), F.xxhash64(TEXT).alias("_llm_h"))
    return rows.join(chosen, ["_llm_k", "_llm_h"]).dropDuplicates(["_llm_k", "_llm_h"]).select(f"{ROW}.*")
