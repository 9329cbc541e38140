"""The stages of the pipeline, one after the other: against brute force over the same documents."""

import collections
import zlib

import numpy as np

import corpus_pipeline
from millrace.llm import queries
from test_dedup import brute_components, brute_fingerprint

FOLDER = "/root/testdata/sf0.001"


def holds(text, item, share=0.2):
    """Whether any passage of the text, of any start and length, is within the share of edits of the item."""
    numbers = {}
    w, q = (np.array([numbers.setdefault(x, len(numbers)) for x in (t or "").encode().lower().split()], int) for t in (text, item))
    at = np.arange(len(w) + 1)
    row = np.zeros(len(w) + 1, int)
    for i, x in enumerate(q, 1):
        new = np.minimum(row + 1, np.concatenate([[i], row[:-1] + (w != x)]))
        row = np.minimum.accumulate(new - at) + at
    return len(q) > 0 and row.min() <= int(share * len(q))


def test_stages_keep_the_right_rows(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    bench = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]

    def stage(name, df):
        path = str(tmp_path / name)
        dict(corpus_pipeline.STAGES)[name](spark, df, FOLDER).write.parquet(path)
        return spark.read.parquet(path)

    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert [s for s, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "benchmark_passages", "source_mix", "token_files"]

    ruled = stage("quality_rules", docs)
    kept = sorted(r.doc_id for r in queries.QUERIES["op10_quality_rules"](spark, FOLDER).collect() if r.kept)
    assert ids(ruled) == kept and 0 < len(kept) < len(rows) and ruled.columns == docs.columns

    single = stage("near_duplicates", ruled)
    kept = sorted(set(brute_components({i: brute_fingerprint(rows[i].text) for i in kept}).values()))
    assert ids(single) == kept

    clean = stage("benchmark_passages", single)
    held = {i for i in kept if any(holds(rows[i].text, item) for _, item in bench)}
    gone = set(kept) - set(ids(clean))
    assert gone <= held and len(gone) >= 0.97 * len(held) and set(ids(clean)) <= set(kept)
    assert {r.doc_id: r for r in clean.collect()} == {i: rows[i] for i in ids(clean)}

    mixed = stage("source_mix", clean)
    clean.write.parquet(str(tmp_path / "again" / "documents.parquet"))
    taken = queries.QUERIES["op3_mix_sources"](spark, str(tmp_path / "again")).collect()
    times = collections.Counter(ids(mixed))
    assert times == {r.doc_id: r.taken // r.size for r in taken if r.taken}

    library, at, want = Tokenizer.from_file(queries.vocabulary()), 0, []
    for i in ids(mixed):
        found = [*library.encode(rows[i].text or "", add_special_tokens=False).ids, 1]
        want.append((i, at, len(found), zlib.crc32(np.array(found, "<u4").tobytes())))
        at += len(found)
    assert sorted(map(tuple, stage("token_files", mixed).collect()), key=lambda r: r[1]) == want
