"""Reading files: CSV with a detected encoding, JSON with flattening, previews."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

# The encodings tried, in order.
ENCODINGS = (
    "utf-8-sig", "utf-8", "utf-16", "utf-16le", "utf-16be", "utf-32", "utf-32le", "utf-32be", "iso-8859-1", "iso-8859-2",
    "iso-8859-5", "iso-8859-6", "iso-8859-7", "iso-8859-8", "windows-1252", "ascii", "shift_jis", "euc-jp", "big5",
    "gb2312", "gbk", "koi8-r", "macroman", "iso-2022-jp",
)
_BOMS = (b"\xff\xfe", b"\xfe\xff")


def decodes(content: bytes, encoding: str) -> bool:
    """Whether all of the content is text of the encoding.

    UTF-16 and UTF-32 need a byte-order mark or NUL bytes: without them almost any even number of bytes would decode.
    """
    if encoding.startswith(("utf-16", "utf-32")) and not (content[:2] in _BOMS or b"\0" in content):
        return False
    try:
        content.decode(encoding)
    except UnicodeError:
        return False
    return True


def guess_encoding(content: bytes) -> str:
    """The first encoding of the list that decodes the content."""
    return next((e for e in ENCODINGS if decodes(content, e)), "iso-8859-1")


# The charsets Spark accepts without its Java charset setting.
_SPARK_CHARSETS = {"iso-8859-1", "us-ascii", "utf-8", "utf-16", "utf-16be", "utf-16le", "utf-32"}


def charset(spark: SparkSession, encoding: str) -> str:
    """The Java name of an encoding; allows the session to use it when Spark's list lacks it."""
    names = {"utf-8-sig": "UTF-8", "macroman": "x-MacRoman", "latin-1": "ISO-8859-1",
             "cp1252": "windows-1252", "ascii": "US-ASCII"}
    name = names.get(encoding.lower(), encoding)
    if name.lower() not in _SPARK_CHARSETS:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return name


def detect_encoding(spark: SparkSession, path: str) -> str:
    """The first encoding of the list that decodes every file of the set, whole.

    Files are decoded where they are read, one encoding a job until one fits all; the first fits most sets. A file over 2 GB
    is beyond one row: name its encoding.
    """
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    if files.isEmpty():
        return "utf-8"

    def failing(encoding):
        def run(batches):
            for batch in batches:
                bad = [not decodes(c.as_py(), encoding) for c in batch.column(0)]
                yield pa.RecordBatch.from_arrays([pa.array([b for b in bad if b], pa.bool_())], ["bad"])

        return run

    return next((e for e in ENCODINGS if files.mapInArrow(failing(e), "bad boolean").isEmpty()), "iso-8859-1")


def read_csv(
    spark: SparkSession, path: str, sep: str = ",", encoding: str | None = None,
    schema: StructType | str | None = None, header: bool = True, multi_line: bool = False,
) -> DataFrame:
    """Delimited text; the encoding is detected unless given, types inferred unless given."""
    encoding = charset(spark, encoding or detect_encoding(spark, path))
    reader = spark.read.option("header", header).option("sep", sep).option("encoding", encoding)
    reader = reader.option("escape", '"').option("multiLine", multi_line)
    if encoding.lower().startswith(("utf-16", "utf-32")):
        reader = reader.option("multiLine", True)  # line splitting needs whole characters
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_json(
    spark: SparkSession, path: str, schema: StructType | str | None = None,
    multi_line: bool = False, flatten: bool = True,
) -> DataFrame:
    """JSON; one document per line by default, so that files split."""
    reader = spark.read.option("multiLine", multi_line)
    df = (reader.schema(schema) if schema else reader).json(path)
    return flatten_nested(df) if flatten else df


def read_file(spark: SparkSession, path: str, file_type: str | None = None) -> DataFrame:
    """Choose the reader from the extension when no type is given."""
    kind = file_type or (re.search(r"\.([A-Za-z]+)/?$", path) or [None, ""])[1].lower()
    readers = {
        "csv": read_csv, "json": read_json, "tsv": lambda s, p: read_csv(s, p, sep="\t"),
        "parquet": lambda s, p: s.read.parquet(p),
        "xml": lambda s, p: s.read.format("xml").option("rowTag", "row").load(p),
    }
    if kind not in readers:
        raise ValueError("unsupported file type: name file_type")
    return readers[kind](spark, path)


def flatten_nested(df: DataFrame, coerce: bool = True, map_keys: int = 1000) -> DataFrame:
    """Lists become rows, structs and maps become columns, until nothing is nested.

    A struct column ``c`` gives ``c_field``; structs inside it join with a dot
    (``c_a.b``). Only the schema decides, so there is no scan, but for maps, whose keys
    are data: at most ``map_keys`` names are read and more raise an error.
    """
    while True:
        nested = next(
            (f for f in df.schema if isinstance(f.dataType, (ArrayType, StructType, MapType))), None
        )
        if nested is None:
            break
        name, kind = nested.name, nested.dataType
        rest = [F.col(f"`{c}`") for c in df.columns if c != name]
        if isinstance(kind, ArrayType):
            df = df.select(*rest, F.explode_outer(f"`{name}`").alias(name))
        elif isinstance(kind, StructType):
            leaves = list(_leaves(kind, F.col(f"`{name}`"), ""))
            df = df.select(*rest, *[c.alias(f"{name}_{path}") for path, c in leaves])
        else:
            keys = [
                r[0] for r in df.select(F.explode(F.map_keys(f"`{name}`"))).distinct()
                .limit(map_keys + 1).collect()
            ]
            if len(keys) > map_keys:
                raise ValueError(f"map column {name} has more than {map_keys} keys")
            df = df.select(*rest, *[
                F.col(f"`{name}`")[k].alias(f"{name}_{k}") for k in sorted(keys)
            ])
    return coerce_numeric(df) if coerce else df


def _leaves(kind: StructType, at, prefix: str):
    for f in kind.fields:
        path = f"{prefix}.{f.name}" if prefix else f.name
        if isinstance(f.dataType, StructType):
            yield from _leaves(f.dataType, at.getField(f.name), path)
        else:
            yield path, at.getField(f.name)


def coerce_numeric(df: DataFrame) -> DataFrame:
    """String columns whose every non-null value is a number become numeric."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, StringType)]
    if not texts:
        return df
    row = df.agg(*[
        x for i, c in enumerate(texts) for x in (
            F.expr(f"count(`{c}`) = count(try_cast(`{c}` AS double)) AND count(`{c}`) > 0").alias(f"d{i}"),
            F.expr(f"count(`{c}`) = count(try_cast(`{c}` AS bigint))").alias(f"l{i}"),
        )
    ]).first()
    kinds = {c: "bigint" if row[f"l{i}"] else "double" for i, c in enumerate(texts) if row[f"d{i}"]}
    return df.select(*[
        F.col(f"`{c}`").cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in df.columns
    ])


def explode_parallel(df: DataFrame) -> DataFrame:
    """All list columns exploded together; rows whose lists differ in length raise."""
    lists = [f.name for f in df.schema if isinstance(f.dataType, ArrayType)]
    if not lists:
        return df
    size = F.coalesce(F.size(lists[0]), F.lit(-1))
    same = F.lit(True)
    for c in lists[1:]:
        same = same & (F.coalesce(F.size(c), F.lit(-1)) == size)
    zipped = F.when(same, F.arrays_zip(*lists)).otherwise(
        F.raise_error(F.lit("list columns differ in length"))
    )
    rest = [c for c in df.columns if c not in lists]
    return df.select(*rest, F.explode_outer(zipped).alias("_z")).select(
        *rest, *[F.col(f"_z.{c}").alias(c) for c in lists]
    )


def preview_files(spark: SparkSession, path: str, rows: int = 5, glob: str | None = None) -> DataFrame:
    """The first ``rows`` lines of every text file under ``path``: (file, line, text).

    The rank keeps only ``rows`` candidates per file and task before the shuffle
    (Spark plans a ``WindowGroupLimit``), so large files are not moved.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    lines = (reader.option("pathGlobFilter", glob) if glob else reader).text(path)
    lines = lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_n"), F.col("value").alias("text"),
    )
    line = F.row_number().over(W.partitionBy("file").orderBy("_at", "_n"))
    return lines.withColumn("line", line).where(F.col("line") <= rows).select("file", "line", "text")


def preview_parquet(spark: SparkSession, paths: list[str], rows: int = 5) -> DataFrame:
    """The first rows of each Parquet file as JSON text: (file, row, record)."""
    out = None
    for p in paths:
        df = spark.read.parquet(p)
        one = df.select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
            F.to_json(F.struct(*df.columns)).alias("record"),
        ).where(F.col("_metadata.row_index") < rows)
        out = one if out is None else out.unionByName(one)
    return out
