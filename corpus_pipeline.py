"""Documents to token files: quality rules, near-duplicates, benchmark passages, source mix, token ids.

Every stage takes (spark, docs, sf_dir) and reads what its predecessor has written; all but the last return the columns of
documents. The mix repeats documents, so ids repeat in the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, mixing, quality, simhash, tokens
from millrace.llm.queries import table, vocabulary
from millrace.session import scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id."""
    return simhash.dedupe(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the written files hold, per document."""
    return tokens.encoded(docs, vocabulary())


STAGES = [
    ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("benchmark_passages", benchmark_passages),
    ("source_mix", source_mix), ("token_files", token_files),
]
#: Hashes of word windows, random walks and a tokenizer are beyond SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
