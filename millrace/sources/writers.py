"""Writing files: delimited text, JSON in several layouts, XML, Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.sources.readers import charset

# Encodings and delimiters offered for export.
CSV_ENCODINGS = ("utf-8", "latin-1", "utf-16", "ISO-8859-1", "cp1252")
DELIMITERS = {"space": " ", "comma": ",", "tab": "\t", "semicolon": ";"}


def write_csv(df: DataFrame, path: str, encoding: str = "utf-8", delimiter: str = "comma",
              mode: str = "errorifexists") -> None:
    (df.write.mode(mode).option("header", True).option("sep", DELIMITERS.get(delimiter, delimiter))
       .option("encoding", charset(df.sparkSession, encoding)).option("escape", '"')
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def write_json(df: DataFrame, path: str, orient: str = "records", key: str | None = None,
               mode: str = "errorifexists") -> None:
    """``records`` (one object per line), ``values`` (one array per line), ``split``
    (index, columns and data per line) or ``index`` (``{key: record}`` per line).

    A single JSON document over all rows would need one task, so each layout is written
    row by row.
    """
    if orient == "records":
        df.write.mode(mode).json(path)
        return
    json_lines(df, orient, key).write.mode(mode).text(path)


def json_lines(df: DataFrame, orient: str, key: str | None = None) -> DataFrame:
    """The text lines ``write_json`` writes for an orient other than ``records``."""
    keep = {"ignoreNullFields": "false"}
    cells = [F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v")), keep), r'(?s)^\{"v":(.*)\}$', 1)
             for c in df.columns if c != key]
    row = F.concat(F.lit("["), F.concat_ws(",", *cells), F.lit("]"))
    if orient == "values":
        return df.select(row.alias("value"))
    if key is None:
        raise ValueError(f"orient {orient} needs a key column")
    ident = F.regexp_extract(F.to_json(F.struct(F.col(key).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    if orient == "index":
        body = F.to_json(F.struct(*[c for c in df.columns if c != key]), keep)
        name = F.when(F.startswith(ident, F.lit('"')), ident).otherwise(F.concat(F.lit('"'), ident, F.lit('"')))
        return df.select(F.concat(F.lit("{"), name, F.lit(":"), body, F.lit("}")).alias("value"))
    if orient == "split":
        names = ",".join(f'"{c}"' for c in df.columns if c != key)
        return df.select(F.concat(
            F.lit(f'{{"columns":[{names}],"index":['), ident, F.lit('],"data":['), row, F.lit("]}"),
        ).alias("value"))
    raise ValueError(f"unknown orient {orient}")


def write_xml(df: DataFrame, path: str, row_tag: str = "row", mode: str = "errorifexists") -> None:
    df.write.mode(mode).format("xml").option("rowTag", row_tag).option("rootTag", "data").save(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", "snappy").parquet(path)
