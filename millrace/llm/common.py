"""What several corpus operators share: words as columns, rows carried whole, text batches for Python tasks."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

#: White space between words: the six ASCII characters, nothing else.
GAP = r"[\x20\x09-\x0D]+"
ROW = "_llm_row"
TEXT = "_llm_text"

#: Bytes of text that a Python task holds at once.
CHUNK_BYTES = 4_000_000


def words(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def carried(docs: DataFrame, text: str) -> DataFrame:
    """Every row whole in ``ROW`` and its text (null: empty) in ``TEXT``, so that no input column can clash."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias(ROW), F.coalesce(docs[text], F.lit("")).alias(TEXT))


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches holding about ``limit`` bytes of text, or one longer row."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch[text]), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if total and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < len(sizes):
            yield batch.slice(start)


def numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Numbers of the words of all texts, the number of words of each text, and the words."""
    split = pc.ascii_split_whitespace(texts)
    found, edges = split.flatten(), split.offsets.to_numpy()
    words = pc.not_equal(pc.binary_length(found), 0)  # white space at an end of a text leaves an empty one
    counts = np.diff(np.append(0, np.cumsum(words.to_numpy(zero_copy_only=False)))[edges - edges[0]])
    coded = found.filter(words).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), counts, coded.dictionary


def listed(words: pa.Array) -> list[bytes]:
    """Words without white space as a list."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), pa.scalar("\n", words.type))[0].as_buffer().to_pybytes().split()


def bounded_batches(spark) -> None:
    """Hold Arrow batches at 16 MB, unless the session names a bound, so that long rows cannot fill a Python worker.

    Spark reads the bound when a query runs, after the operator has returned, so it stays set in the session.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.sparkContext.getConf().toDebugString():
        spark.conf.set(name, str(16 << 20))


#: Stands for a null id where ids are compared; nulls come first.
NULL_ID = -(1 << 63)


def shared_value(spark, value) -> Broadcast:
    """Broadcast an object of this package: its classes travel with it, as workers need no copy of the package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(sent: Broadcast):
    """The object of ``shared_value``, inside a task."""
    return pickle.loads(sent.value)
