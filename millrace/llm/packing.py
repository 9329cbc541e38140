"""Packing of token ids into training windows by the sum-of-squares rule.

Whole windows of a long document go out as they are; what is left of it, or a whole shorter document, is an item. An item goes to
the fill level at which the sum of squared counts of partly filled windows grows least (an empty window is a level too), so that no
level is crowded and most items meet a window that they fill. The counts are a level array of one number per fill level.

Every task packs the documents of its own partition, so nothing is shuffled and no state is shared; sequence ids carry the
partition in their upper bits. At the end of a partition the windows still open are laid end to end and cut into full windows; the
last rest, less than one window, is cut into sequences whose lengths are powers of two. So no sequence needs padding: all are of
``window`` tokens or of a power of two, and of the short ones there are at most log2(window) per partition.
Only what lies in windows that stayed open is cut.

A task holds the ids of one chunk of texts (1 MB, or one longer text) and of the open windows; windows are written as they fill.
The squares keep open windows few; at more than ``OPEN`` they are closed early by the same cutting as at the end, so memory is
bounded for any order and size of documents.

Null texts count as empty: one end id. Null ids and repeated rows are documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.common import ROW, TEXT, bounded_batches, carried, chunks
from millrace.llm.tokens import worker_encoder

WINDOW, END_ID = 4096, 2
#: Windows that a task holds open (16 KB of ids each).
OPEN = 8_192
#: Pieces that a task holds before it writes them.
BATCH = 50_000


class Packer:
    """Windows of one task. Pieces are (document, start, ids), where a document is any handle; ``closed`` holds finished windows."""

    def __init__(self, window: int = WINDOW, most: int = OPEN):
        self.window, self.most = window, most
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(window + 1)]
        self.closed: list[list[tuple]] = []
        self.levels = np.arange(window + 1)

    def add(self, document, ids: np.ndarray) -> None:
        whole = len(ids) // self.window * self.window
        for a in range(0, whole, self.window):
            self.closed.append([(document, a, ids[a:a + self.window])])
        if whole < len(ids):
            self.place((document, whole, ids[whole:]))

    def place(self, piece: tuple) -> None:
        size, count, window = len(piece[2]), self.count, self.window
        # Half the growth of the sum of squares if the item goes to each level h: one window less at h, one more at h + size.
        fits = self.levels[:window - size + 1]
        fits = fits[(count[:window - size + 1] > 0) | (fits == 0)]
        growth = np.where(fits + size < window, count[fits + size] + 0.5, 0.0) - np.where(fits > 0, count[fits] - 0.5, 0.0)
        best = np.flatnonzero(growth == growth.min())[-1]  # of equals the fullest
        level = int(fits[best])
        pieces = self.open[level].pop() if level else []
        self.count[level] -= level > 0
        pieces.append(piece)
        if level + size == window:
            self.closed.append(pieces)
            return
        self.open[level + size].append(pieces)
        self.count[level + size] += 1
        if self.count.sum() > self.most:
            self.cut(last=False)

    def cut(self, last: bool = True) -> None:
        """Close the open windows, fullest first: end to end in full windows, and (``last``) the rest in powers of two."""
        held, room = [], self.window
        for level in range(self.window - 1, 0, -1):
            for pieces in self.open[level]:
                for document, start, ids in pieces:
                    while len(ids):
                        part = ids[:room]
                        held.append((document, start, part))
                        start, ids, room = start + len(part), ids[len(part):], room - len(part)
                        if not room:
                            self.closed.append(held)
                            held, room = [], self.window
            self.open[level] = []
        self.count[:] = 0
        if held and not last:
            level = self.window - room
            self.open[level], self.count[level] = [held], 1
            return
        while held:
            room = 1 << (sum(len(p[2]) for p in held).bit_length() - 1)
            now: list[tuple] = []
            while room:
                document, start, ids = held.pop(0)
                part = ids[:room]
                now.append((document, start, part))
                room -= len(part)
                if len(part) < len(ids):
                    held.insert(0, (document, start + len(part), ids[len(part):]))
            self.closed.append(now)


def packed(
    docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END_ID, most: int = OPEN,
    ids: bool = False,
) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset) per piece; with ``ids`` also the ids themselves."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    slim = carried(docs.select(*dict.fromkeys([key, text])), text).select(F.col(ROW)[key].alias("key"), TEXT)
    numbers = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        from pyspark import TaskContext

        encoder, packer, sequence = worker_encoder(vocabulary), Packer(window, most), TaskContext.get().partitionId() << 40
        keys: list[pa.Array] = []

        def written():
            nonlocal sequence
            rows, names, lists = [], [], []
            for pieces in packer.closed:
                offset = 0
                for (name, tokens), start, part in pieces:
                    rows.append((start, len(part), zlib.crc32(np.ascontiguousarray(part, "<u4")), tokens, sequence, offset))
                    names.append(name)
                    if ids:
                        lists.append(part.astype(np.int64))
                    offset += len(part)
                sequence += 1
            packer.closed = []
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(numbers)
            more = [pa.array(lists, pa.list_(pa.int64()))] if ids else []
            return pa.RecordBatch.from_arrays([pa.array(names, keys[0].type), *columns, *more], ["key", *numbers, *(["ids"] if ids else [])])

        for batch in batches:
            for piece in chunks([batch], TEXT, 1_000_000):
                keys = [piece["key"]]
                flat, sizes = encoder.texts(piece[TEXT].to_pylist(), end)
                at = 0
                for name, n in zip(piece["key"].to_pylist(), sizes.tolist()):
                    # A copy, so that an open window does not keep the ids of its whole chunk.
                    packer.add((name, n), flat[at:at + n] if n >= window else flat[at:at + n].copy())
                    at += n
                    if len(packer.closed) >= BATCH:
                        yield written()
                if packer.closed:
                    yield written()
        packer.cut()
        if packer.closed:
            yield written()

    made = slim.mapInArrow(run, f"key {kind}, {', '.join(f'{c} long' for c in numbers)}{', ids array<long>' if ids else ''}")
    return made.withColumnRenamed("key", key)
