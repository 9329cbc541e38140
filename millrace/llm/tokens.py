"""Token ids in patched frame-of-reference files.

A segment is one record of the files: whole documents in ascending id order, their lengths, and one payload

    magic, ids, blocks | byte start of each block and the end | blocks

where a block is ``base, count, exceptions, width``, the ids less their minimum packed at ``width`` bits, then places and high
parts of the exceptions. The width is the least that holds ``PERCENTILE`` of the block's values; the others keep their low bits in
place and their high part in the exception list. All numbers are little-endian. The container is Parquet, so any store that Spark
reads will do, a lost task only rewrites its own part, and readers start at any segment, or at any block by the index.

Ids are those of the ``tokenizers`` library. Its vocabulary splits at white space first and its normaliser does not look across
it, so a distinct word is encoded once while a Python worker keeps its ids. Where the library also parts a word after each letter
before a mark or digit, words are cut there beforehand: "word," and "word" share their ids.

Null texts count as empty. Null ids come first; rows alike in id are ordered by a hash of the text. An empty table gives empty files.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm.common import ROW, TEXT, bounded_batches, carried, chunks, listed, numbered
from millrace.session import scratch_path

MAGIC = b"PFR1"
BLOCK, PERCENTILE = 8192, 0.95
SEGMENT_IDS = 1 << 19
END_ID = 1
#: Distinct words whose ids a Python worker keeps (about 175 bytes each).
WORDS_KEPT = 250_000
#: Words that go to the library as one line, as longer lines take it longer a word, and lines that go there at once.
LINE, LINES = 50, 200
#: A pattern by which the library may find the parts of words. None of its parts goes on from a letter to anything but a letter.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters of ASCII and Latin-1 in UTF-8. They stay as they are in NFC, and are letters in either case.
LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: Layouts of the heads of a payload and of a block.
HEAD, BLOCK_HEAD = "<4sQI", "<IIIB"


def pack(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each value, one after the other in 64-bit words."""
    if not width or not len(values):
        return b""
    rows = np.zeros((-(-len(values) // 64), 64), np.uint64)
    rows.ravel()[:len(values)] = values
    rows &= np.uint64((1 << width) - 1)
    # 64 values fill ``width`` words, and each value of the 64 has its place in one or two of them.
    out = np.zeros((len(rows), width), np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        out[:, word] |= rows[:, i] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= rows[:, i] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()[:(len(values) * width + 7) // 8]


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    if not width or not n:
        return np.zeros(n, np.uint32)
    count = -(-n // 64)
    words = np.frombuffer(bytes(data).ljust(count * width * 8, b"\0"), "<u8").reshape(count, width)
    rows = np.empty((count, 64), np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        rows[:, i] = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            rows[:, i] |= words[:, word + 1] << np.uint64(64 - shift)
    rows &= np.uint64((1 << width) - 1)
    return rows.ravel()[:n].astype(np.uint32)


def encode_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    base = int(ids.min())
    rest = (ids - np.uint32(base)).astype(np.uint32)
    at = min(len(rest) - 1, int(np.ceil(percentile * len(rest))) - 1)
    width = int(np.partition(rest, at)[at]).bit_length()
    high = rest >> np.uint32(width) if width < 32 else np.zeros_like(rest)
    places = np.nonzero(high)[0]
    return b"".join([struct.pack(BLOCK_HEAD, base, len(ids), len(places), width), pack(rest, width),
                     places.astype("<u4").tobytes(), high[places].astype("<u4").tobytes()])


def decode_block(data: memoryview) -> np.ndarray:
    base, n, exceptions, width = struct.unpack_from(BLOCK_HEAD, data)
    packed = struct.calcsize(BLOCK_HEAD) + (n * width + 7) // 8
    rest = unpack(data[struct.calcsize(BLOCK_HEAD):packed], n, width)
    if exceptions:
        places = np.frombuffer(data[packed:packed + 4 * exceptions], "<u4")
        rest[places] |= np.frombuffer(data[packed + 4 * exceptions:packed + 8 * exceptions], "<u4") << np.uint32(width)
    return rest + np.uint32(base)


def encode(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """The payload of a sequence of ids."""
    ids = np.ascontiguousarray(ids, np.uint32)
    blocks = [encode_block(ids[i:i + block], percentile) for i in range(0, len(ids), block)]
    starts = np.cumsum([0, *map(len, blocks)]) + struct.calcsize(HEAD) + 8 * (len(blocks) + 1)
    return b"".join([struct.pack(HEAD, MAGIC, len(ids), len(blocks)), starts.astype("<u8").tobytes(), *blocks])


def decode(data: bytes, start: int = 0, stop: int | None = None, block: int = BLOCK) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a payload; only the blocks that hold them are unpacked."""
    magic, n, blocks = struct.unpack_from(HEAD, data)
    if magic != MAGIC:
        raise ValueError("not a payload of token ids")
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.zeros(0, np.uint32)
    starts, view = np.frombuffer(data, "<u8", blocks + 1, struct.calcsize(HEAD)), memoryview(data)
    first, last = start // block, (stop - 1) // block
    got = np.concatenate([decode_block(view[int(starts[i]):int(starts[i + 1])]) for i in range(first, last + 1)])
    return got[start - first * block:stop - first * block]


class Places(dict):
    """A number for each distinct word, in the order of their first use."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        self.new.append(word)
        return place


class Encoder:
    """Ids of whole texts, word by word, each distinct word through the library once while its ids are kept."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        special = [(i, t.content) for i, t in self.library.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip)]
        self.mark = special[0] if special and not self.library.encode_special_tokens else None
        self.apart = [t.content.lower().encode() for t in self.library.get_added_tokens_decoder().values()]
        setup = json.loads(self.library.to_str())
        steps, splits = setup["normalizer"] or {}, setup["pre_tokenizer"] or {}
        steps, splits = steps.get("normalizers", [steps]), splits.get("pretokenizers", [splits])
        self.folds = any(x.get("type") == "Lowercase" for x in steps) and all(
            x.get("type") in ("NFC", "Lowercase") or x.get("pattern") == {"Regex": r"\s+"} for x in steps)
        found = {"type": "Split", "pattern": {"Regex": PARTS}, "behavior": "Removed", "invert": True}
        self.parts = self.folds and splits[:1] == [found] and all(
            (x.get("type"), x.get("add_prefix_space"), x.get("use_regex")) == ("ByteLevel", False, False) for x in splits[1:])
        suffix, vocabulary = setup["model"].get("end_of_word_suffix"), setup["model"]["vocab"]
        self.closes = None
        if self.parts and suffix and setup["model"]["type"] == "BPE" and all(LETTERS.sub(b"", a).strip() for a in self.apart):
            # Which ids end a part. Its suffix cannot come from a word of letters, so they end one and only one.
            self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
            self.closes[[i for word, i in vocabulary.items() if word.endswith(suffix)]] = not suffix.isalpha()
        self.is_letter, self.is_mark, self.is_second = np.zeros((3, 256), bool)
        self.is_letter[[b for b in range(0x80) if LETTERS.fullmatch(bytes([b]))]] = True
        self.is_second[[b for b in range(0x80, 0x100) if LETTERS.fullmatch(bytes([0xC3, b]))]] = True
        self.is_mark[0x21:0x7F] = ~self.is_letter[0x21:0x7F]
        self.reset()

    def reset(self):
        self.place = Places()
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def folded(self, texts: list[bytes]) -> tuple[bytes, np.ndarray]:
        """All texts, one after the other, and their edges. ASCII letters are in lower case, if the library makes them so anyway: one word
        in place of two. Letters have a gap before marks and digits, if the library parts words there.

        Left as they are: texts with the text of an added token, whose case counts, and those with combining marks (U+0300 to U+037F),
        which may be composed with letters of one case only.
        """
        data, edges = b"".join(texts), np.cumsum([0, *map(len, texts)])
        if not self.folds:
            return data, edges
        low = data.lower()
        if b"\xcc" in data or b"\xcd" in data or any(a in low for a in self.apart):
            if len(texts) == 1:
                return data, edges
            each = [self.folded([t])[0] for t in texts]
            return b"".join(each), np.cumsum([0, *map(len, each)])
        if not self.parts:
            return low, edges
        code = np.frombuffer(low, np.uint8)
        marks = np.flatnonzero(self.is_mark[code[1:]]) + 1
        before, first = code[marks - 1], code[np.maximum(marks - 2, 0)] == 0xC3
        cuts = marks[self.is_letter[before] | first & self.is_second[before]]
        return np.insert(code, cuts, ord(" ")).tobytes(), edges + np.searchsorted(cuts, edges)

    def of_lines(self, lines: list[str]) -> np.ndarray:
        """Ids of these lines, one after the other."""
        found = (self.library.encode_batch_fast(lines[i:i + LINES], add_special_tokens=False) for i in range(0, len(lines), LINES))
        return np.concatenate([np.zeros(0, np.uint32), *[np.array(e.ids, np.uint32) for batch in found for e in batch]])

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these words and the number of ids of each. Words travel in lines with a special token between them, at which the
        library parts a text before all else; that saves an object per word."""
        if self.mark is None or any(self.mark[1] in w for w in words):
            ids = [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes
        flat = self.of_lines([self.mark[1].join(["", *words[i:i + LINE]]) for i in range(0, len(words), LINE)])
        marks = np.flatnonzero(flat == self.mark[0])
        sizes = np.diff(marks, append=len(flat)) - 1
        return np.delete(flat, marks), sizes

    def encoded_letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of ``LETTERS`` only, each of which is one part: they travel with a space between them, which gives no ids."""
        flat = self.of_lines([" ".join(words[i:i + LINE]) for i in range(0, len(words), LINE)])
        ends = np.flatnonzero(self.closes[flat])
        if len(ends) != len(words) or ends[-1] != len(flat) - 1:  # letters that the vocabulary lacks
            return self.encoded(words)
        return flat, np.diff(ends, prepend=-1)

    def encoded_plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of a to z only, from the library's model: its steps before leave such words as they are, and whole."""
        tokenize, flat, sizes = self.library.model.tokenize, [], []
        for word in words:
            found = [t.id for t in tokenize(word)]
            flat += found
            sizes.append(len(found))
        return np.array(flat, np.uint32), np.array(sizes, np.int64)

    def learn(self):
        """Encode the words that were met since the last call."""
        new, self.place.new = self.place.new, []
        n = len(self.place)
        while len(self.start) < n:
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        kinds = np.zeros(len(new), np.int8)
        if self.closes is not None:  # isalpha and islower of bytes look at ASCII
            kinds[:] = [2 if w.isalpha() and w.islower() else 1 if LETTERS.fullmatch(w) else 0 for w in new]
        for kind, encode in enumerate((self.encoded, self.encoded_letters, self.encoded_plain)):
            places = np.flatnonzero(kinds == kind)
            if not len(places):
                continue
            flat, sizes = encode([new[i].decode() for i in places.tolist()])
            need = self.used + len(flat)
            while len(self.flat) < need:
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used:need] = flat
            self.size[n - len(new) + places] = sizes
            self.start[n - len(new) + places] = self.used + np.cumsum(sizes) - sizes
            self.used = need

    def texts(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by ``end``, and the length of each."""
        if len(self.place) > WORDS_KEPT:
            self.reset()
        data, edges = self.folded([t.encode() for t in texts])
        found, counts, names = numbered(pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)]))
        at = np.fromiter(map(self.place.__getitem__, listed(names)), np.int64, len(names))[found]
        self.learn()
        size = self.size[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        lengths = ends[np.cumsum(counts)] - ends[np.cumsum(counts) - counts] + 1
        out = np.full(int(lengths.sum()), end, np.uint32)
        if len(at):
            inner = np.ones(len(out), bool)
            inner[np.cumsum(lengths) - 1] = False
            out[inner] = self.flat[np.repeat(self.start[at] - ends[:-1], size) + np.arange(ends[-1])]
        return out, lengths


def worker_encoder(path: str) -> Encoder:
    """One encoder for all tasks of a Python worker. This package travels by value, so it is kept with the library's module."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_encoders_of_worker", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def write(docs: DataFrame, path: str, vocabulary: str, key: str = "doc_id", text: str = "text", end: int = END_ID) -> None:
    """Encode every document and write the segments under ``path``, in ascending order of ``key``."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType
    slim = carried(docs.select(*dict.fromkeys([key, text])), text).select(F.col(ROW)[key].alias(key), TEXT)
    # Ranges of key and text hash, so that Spark's range sample holds no texts; rows alike in both are the same text.
    slim = slim.withColumn("_llm_tie", F.xxhash64(TEXT))
    order = [F.col(key).asc_nulls_first(), F.col("_llm_tie")]
    ordered = slim.repartitionByRange(*order).sortWithinPartitions(*order).drop("_llm_tie")

    def run(batches):
        from pyspark import TaskContext

        part, before, encoder = TaskContext.get().partitionId(), 0, worker_encoder(vocabulary)
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def segment():
            nonlocal before, held
            keys, ids, sizes = pa.concat_arrays([h[0] for h in held]), *(np.concatenate([h[i] for h in held]) for i in (1, 2))
            out = pa.RecordBatch.from_arrays([
                pa.array([part]), pa.array([before]), pa.array([len(ids)]), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
                pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), pa.array(sizes)), pa.array([encode(ids)], pa.binary()),
            ], ["part", "part_start", "ids", "keys", "lengths", "payload"])
            before, held = before + len(ids), []
            return out

        for batch in batches:
            for piece in chunks([batch], TEXT, 1_000_000):
                held.append((piece[key], *encoder.texts(piece[TEXT].to_pylist(), end)))
                if sum(len(h[1]) for h in held) >= SEGMENT_IDS:
                    yield segment()
        if held:
            yield segment()

    ordered.mapInArrow(run, f"part long, part_start long, ids long, keys array<{kind.simpleString()}>, lengths array<long>, payload binary").write.parquet(path)


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(key, start, n_tokens, ids) per document from the files, or with ``ids_crc32`` in place of the ids."""
    segments = spark.read.parquet(path)
    kind = segments.schema["keys"].dataType.elementType.simpleString()
    # One number per part, of which there are as many as shuffle partitions.
    sizes, total = {r[0]: r[1] for r in segments.groupBy("part").agg(F.sum("ids")).collect()}, 0
    bases = []
    for part in sorted(sizes):
        bases.append((part, total))
        total += sizes[part]
    last = ("ids_crc32", pa.int64()) if digest else ("ids", pa.list_(pa.int64()))

    def run(batches):
        for batch in batches:
            for part, before, keys, lengths, payload in zip(
                    batch["part"].to_pylist(), batch["part_start"].to_pylist(), batch["keys"], batch["lengths"], batch["payload"]):
                sizes = np.asarray(lengths.values, np.int64)
                ends = np.cumsum(sizes)
                ids = decode(payload.as_py())
                if digest:
                    view = memoryview(ids.astype("<u4", copy=False)).cast("B")
                    out = pa.array([zlib.crc32(view[4 * a:4 * b]) for a, b in zip((ends - sizes).tolist(), ends.tolist())], last[1])
                else:
                    out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [keys.values, pa.array(np.full(len(sizes), part)), pa.array(before + ends - sizes), pa.array(sizes), out],
                    ["key", "part", "at", "n_tokens", last[0]])

    got = segments.select("part", "part_start", "keys", "lengths", "payload").mapInArrow(
        run, f"key {kind}, part long, at long, n_tokens long, {last[0]} {'long' if digest else 'array<long>'}")
    base = F.broadcast(spark.createDataFrame(bases, "part long, base long"))
    return got.join(base, "part").select("key", (F.col("base") + F.col("at")).alias("start"), "n_tokens", last[0])


def encoded(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", end: int = END_ID, path: str | None = None) -> DataFrame:
    """Write the files (in the shared folder, if no path is given) and return (key, start, n_tokens, ids_crc32) read back from them."""
    path = path or scratch_path(docs.sparkSession, "tokens")
    write(docs, path, vocabulary, key, text, end)
    return read(docs.sparkSession, path, digest=True).withColumnRenamed("key", key)
