"""Resampling of documents towards a target distribution by hashed n-gram features and Gumbel keys.

Features are runs of one to ``n`` consecutive words; a feature's bucket is the CRC-32 of its UTF-8 bytes modulo ``BUCKETS``. The
gain of a bucket says how much likelier it is in the target than in the corpus; a document's weight sums the gains of its features,
and the documents with the largest weight plus seeded Gumbel noise are drawn, which is sampling without replacement by weight.

Texts are read by an Aho-Corasick automaton. Per block of text (``BLOCK_BYTES``) its distinct words, bounded by a delimiter on both
sides, become the dictionary; each carries the CRC and the length of its bytes as payload. One scan of the block emits the payloads
in order of the text, since a delimiter lies between any two words and exactly one entry ends at each. The CRC of a run of words is
composed from the payloads of neighbours, as ``crc(a + b) = shift(crc(a), len(b)) ^ crc(b)`` and the shift is linear, so no run is
ever put together as text. The same scan serves counting and scoring. Blocks are cut between words, and a text longer than a block
goes on in the next with the payloads of its last words, so memory does not grow with a text.

Bucket counts are one row of ``BUCKETS`` numbers per task, summed by bucket; gains are a broadcast of ``BUCKETS`` numbers. The order
of scores is cut into ranges over the whole (score, id) order, so no task ranks all rows.

Null texts have no words. A null id counts as the text "null" in the noise and comes first among equals. Rows alike in id and score
are ordered by a hash of their text and ranked as documents of their own. An empty corpus gives an empty result; an empty target gives gains by the
corpus alone.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace import ordered
from millrace.llm.common import ROW, TEXT, bounded_batches, carried, chunks
from millrace.session import cut_lineage

N, BUCKETS, PERCENT, LEAST_WORDS, SEED = 1, 10_000, 10, 20, 2024
BLOCK_BYTES = 2_000_000
#: Every byte that no word holds, and upper case as lower case.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


class Shifts(dict):
    """For a number of bytes, what that many more bytes do to a CRC: four tables of 256, one for each of its bytes."""

    def __missing__(self, size: int) -> np.ndarray:
        zeros = bytes(size)
        start = zlib.crc32(zeros)
        bits = np.array([zlib.crc32(zeros, 1 << b) ^ start for b in range(32)], np.uint32).reshape(4, 8)
        tables = np.zeros((4, 256), np.uint32)
        for b in range(8):
            tables[:, 1 << b:2 << b] = tables[:, :1 << b] ^ bits[:, b:b + 1]
        self[size] = tables
        return tables


def composed(crc: np.ndarray, tail_crc: np.ndarray, tail_size: np.ndarray, shifts: Shifts) -> np.ndarray:
    """CRC of each text followed by its tail."""
    out = np.empty_like(crc)
    for size in np.unique(tail_size).tolist():
        at = tail_size == size
        t, c = shifts[size], crc[at]
        out[at] = t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24]
    return out ^ tail_crc


def blocks(texts: Iterator[tuple[int, str]], limit: int) -> Iterator[list[tuple[int, bytes]]]:
    """Pieces (document, lower-cased bytes with words between single-byte delimiters) in blocks of about ``limit`` bytes, cut between words."""
    held, size = [], 0
    for i, text in texts:
        data, at = text.encode().translate(PLAIN), 0
        while at < len(data) or not data:
            stop = at + limit - size
            if stop < len(data) and (stop := data.find(b" ", stop)) < 0:
                stop = len(data)
            piece = data[at:stop]
            held.append((i, piece))
            size, at = size + len(piece), min(max(stop, at), len(data))
            if size >= limit:
                yield held
                held, size = [], 0
            if not data:
                break
    if held:
        yield held


def scanned(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC and length of every word of the pieces in order, and the number of words of each piece."""
    from ahocorasick import STORE_INTS, Automaton

    found = list(set(b" ".join(pieces).split()))
    automaton = Automaton(STORE_INTS)
    for i, word in enumerate(found, 1):
        automaton.add_word(f" {word.decode('latin-1')} ", i)
    automaton.add_word(" \n ", 0)  # the end of a piece; no word holds a line feed
    automaton.make_automaton()
    # Bytes as characters of the same number: the automaton reads characters.
    line = " \n ".join(b" ".join(p.split()).decode("latin-1") for p in pieces)
    at = np.fromiter(map(itemgetter(1), automaton.iter(f" {line} \n ")), np.int64)
    ends = np.flatnonzero(at == 0)
    at = at[at > 0] - 1
    crc = np.fromiter(map(zlib.crc32, found), np.uint32, len(found))
    size = np.fromiter(map(len, found), np.int64, len(found))
    return crc[at], size[at], np.diff(ends, prepend=-1) - 1


class Features:
    """Feature buckets of texts, block after block."""

    def __init__(self, n: int = N, buckets: int = BUCKETS, limit: int = BLOCK_BYTES):
        self.n, self.buckets, self.limit, self.shifts = n, buckets, limit, Shifts()

    def of(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(document of each feature, bucket of each feature, documents, their words) per block; a long text is in several."""
        none = (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        last, tail = -1, none
        for held in blocks(enumerate(texts), self.limit):
            crc, size, counts = scanned([p for _, p in held])
            docs = np.array([d for d, _ in held], np.int64)
            owner = np.repeat(docs, counts)
            lead = len(tail[0]) if self.n > 1 and len(docs) and docs[0] == last else 0
            if lead:  # the text goes on: its last words stand before, and only runs that end in this block count
                crc, size, owner = np.concatenate([tail[0], crc]), np.concatenate([tail[1], size]), np.concatenate([np.full(lead, last), owner])
            found, of = [crc[lead:] % self.buckets], [owner[lead:]]
            run = crc
            for k in range(2, self.n + 1):
                # A run of k words ends where its last word is; its head is the run of k - 1 words before.
                ends = np.arange(k - 1, len(crc))
                head = composed(run[:-1], np.uint32(zlib.crc32(b" ")), np.ones(len(run) - 1, np.int64), self.shifts) if len(run) > 1 else run[:0]
                run = composed(head, crc[ends], size[ends], self.shifts) if len(head) else head
                whole = (owner[ends] == owner[ends - k + 1]) & (ends >= lead) if len(head) else np.zeros(0, bool)
                found.append(run[whole] % self.buckets)
                of.append(owner[ends][whole] if len(head) else owner[:0])
            if len(docs):
                last = int(docs[-1])
                mine = np.flatnonzero(owner == last)[max(0, (owner == last).sum() - self.n + 1):] if self.n > 1 else np.zeros(0, np.int64)
                tail = (crc[mine], size[mine])
            yield np.concatenate(of), np.concatenate(found).astype(np.int64), docs, counts


def bucket_counts(df: DataFrame, text: str = "text", n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts by bucket."""
    bounded_batches(df.sparkSession)

    def run(batches):
        total, features = np.zeros(buckets, np.int64), Features(n, buckets)
        for batch in batches:
            for part in chunks([batch], TEXT, BLOCK_BYTES):
                for _, found, _, _ in features.of(part[TEXT].to_pylist()):
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return carried(df.select(text), text).select(TEXT).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of every bucket from the counts of both sides, a whole number of thousandths."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for out, counts in ((s, corpus), (t, target)):
        for bucket, n in counts.collect():  # at most one row for each bucket
            out[bucket] = n
    top, bottom = (t + 1) * (s.sum() + buckets), (s + 1) * (t.sum() + buckets)
    return np.array([math.floor(1000 * math.log(x)) for x in (top / bottom).tolist()], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", n: int = N) -> DataFrame:
    """(key, n_words, n_features, weight, text_hash) per document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sent, kind = spark.sparkContext.broadcast(gain), docs.schema[key].dataType.simpleString()
    slim = carried(docs.select(*dict.fromkeys([key, text])), text).select(
        F.col(ROW)[key].alias("key"), TEXT, F.xxhash64(TEXT).alias("text_hash"))

    def run(batches):
        gain = sent.value
        features = Features(n, len(gain))
        for batch in batches:
            for part in chunks([batch], TEXT, BLOCK_BYTES):
                words, made, weight = (np.zeros(part.num_rows, np.int64) for _ in range(3))
                for owner, found, docs_, counts in features.of(part[TEXT].to_pylist()):
                    np.add.at(words, docs_, counts)
                    made += np.bincount(owner, minlength=part.num_rows)
                    np.add.at(weight, owner, gain[found])
                yield pa.RecordBatch.from_arrays(
                    [part["key"], pa.array(words), pa.array(made), pa.array(weight), part["text_hash"]], ["key", "n_words", "n_features", "weight", "text_hash"])

    return slim.mapInArrow(run, f"key {kind}, n_words long, n_features long, weight long, text_hash long")


def resampled(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", n: int = N, buckets: int = BUCKETS,
    percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
) -> DataFrame:
    """(key, n_features, weight, score, rank, text_hash) per document; the rank of those not drawn is null.

    Of the documents with at least ``least_words`` words, ``percent`` in a hundred (rounded down) are drawn.
    """
    gain = gains(bucket_counts(docs, text, n, buckets), bucket_counts(target, target_text, n, buckets), buckets)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    table = cut_lineage(weighed(docs, gain, key, text, n).withColumn("score", (F.col("weight") + noise).cast("long")))
    table = table.withColumns({"_late": (F.col("n_words") < least_words).cast("int"), "_down": -F.col("score"), "_known": F.col("key").isNotNull().cast("int")})
    drawn = percent * table.where("_late = 0").count() // 100
    placed = ordered.with_position(table, ["_late", "_down", "_known", "key", "text_hash"], name="_at")
    rank = F.when((F.col("_late") == 0) & (F.col("_at") < drawn), F.col("_at") + 1)
    return placed.select(F.col("key").alias(key), "n_features", "weight", "score", rank.alias("rank"), "text_hash")


def drawn(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents drawn, all their columns; of rows alike in id and text all that were drawn."""
    chosen = resampled(docs, target, key, text, **how).where("rank IS NOT NULL").groupBy(key, "text_hash").agg(F.count(F.lit(1)).alias("_llm_n"))
    chosen = chosen.select(F.col(key).alias("_llm_k"), F.col("text_hash").alias("_llm_h"), "_llm_n")
    rows = carried(docs, text).select(ROW, F.col(ROW)[key].alias("_llm_key"), F.xxhash64(TEXT).alias("_llm_hash"))
    met = rows.join(chosen, F.col("_llm_key").eqNullSafe(F.col("_llm_k")) & (F.col("_llm_hash") == F.col("_llm_h")))
    met = cut_lineage(met.withColumn("_llm_order", F.xxhash64(ROW)))
    placed = ordered.with_position(met, ["_llm_order"], ["_llm_key", "_llm_hash"], name="_llm_nth")
    return placed.where(F.col("_llm_nth") < F.col("_llm_n")).select(f"{ROW}.*")
