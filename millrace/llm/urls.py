"""URL filters: a blocked Bloom filter over listed entries in front of an exact hash join.

An entry is a host and a path. It fits a URL whose host is the entry's or one of its subdomains and whose path starts with the
entry's path; the longest fitting entry decides, and a URL that none fits gets the default verdict. Every URL yields the keys
under which an entry could be listed (each suffix of its host by labels, with each prefix of its path of a length that occurs
in the list). Keys are tested against a split-block Bloom filter of 512-bit blocks, eight words with one bit each; those that
may be listed go on to the exact join, which removes false positives.

Verdicts are found per distinct (host, path), so a hot URL is one row until they are joined back. Null URLs and such without
``://`` have empty host and path. Repeated rows are judged alike, an empty table gives an empty result, and with an empty list
every URL gets the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.common import ROW

WORDS, BITS_PER_ENTRY, BLOCK_BITS = 8, 16, 512
#: Listed entries up to which filter and matches are broadcast (under 10 MB); beyond, both are shuffled joins.
SMALL_LIST = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bit(key: Column, word: int) -> Column:
    place = F.shiftright(F.xxhash64(key, F.lit(7)), 6 * word).bitwiseAND(F.lit(63))
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """One row per used block: its number and eight words of 64 bits."""
    return listed.groupBy(_block(F.col("_llm_key"), blocks).alias("_llm_block")).agg(
        *[F.bit_or(_bit(F.col("_llm_key"), i)).alias(f"_llm_w{i}") for i in range(WORDS)])


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """The whole input row in ``ROW`` with ``host``, ``path``, ``rule`` (null: none) and ``verdict``.

    ``rules`` has columns host, path, verdict; of entries listed twice the smallest verdict counts.
    """
    listed = rules.groupBy(F.translate("host", UPPER, LOWER).alias("_llm_h"), F.col("path").alias("_llm_p")).agg(
        F.min("verdict").alias("_llm_verdict"))
    listed = listed.withColumn("_llm_key", F.concat("_llm_h", F.lit("\n"), "_llm_p"))
    seen = listed.agg(F.count(F.lit(1)), F.collect_set(F.length("_llm_p"))).first()
    entries, lengths = seen[0], sorted(seen[1])
    small = entries <= SMALL_LIST
    held = F.broadcast if small else (lambda df: df)
    blocks = max(1, -(-entries * BITS_PER_ENTRY // BLOCK_BITS))
    filt = bloom(listed, blocks)

    rows = pages.select(F.struct(*[pages[c] for c in pages.columns]).alias(ROW), host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]).cast("array<string>"),
                        lambda p: p.isNotNull())
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, F.lit("\n"), p))))
    urls = rows.where("host != ''").select("host", "path").distinct()
    tried = urls.select("host", "path", F.explode(keys).alias("_llm_try")).withColumn("_llm_at", _block(F.col("_llm_try"), blocks))
    may = tried.join(held(filt), F.col("_llm_at") == F.col("_llm_block"))
    for i in range(WORDS):
        may = may.where(F.col(f"_llm_w{i}").bitwiseAND(_bit(F.col("_llm_try"), i)) != 0)
    exact = listed.select("_llm_key", F.concat("_llm_h", "_llm_p").alias("_llm_rule"), "_llm_verdict")
    exact = F.broadcast(exact) if small else exact.hint("shuffle_hash")
    hits = may.select("host", "path", "_llm_try").join(exact, F.col("_llm_try") == F.col("_llm_key"))
    best = hits.groupBy("host", "path").agg(
        F.max(F.struct(F.length("_llm_rule").alias("n"), F.col("_llm_rule").alias("rule"), F.col("_llm_verdict").alias("verdict"))).alias("_llm_best"))
    best = best.select(F.col("host").alias("_llm_bh"), F.col("path").alias("_llm_bp"), "_llm_best")
    out = rows.join(best, (F.col("host") == F.col("_llm_bh")) & (F.col("path") == F.col("_llm_bp")), "left")
    return out.select(ROW, "host", "path", F.col("_llm_best.rule").alias("rule"),
                      F.coalesce(F.col("_llm_best.verdict"), F.lit(default)).alias("verdict"))


def allowed(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """The pages whose URL is allowed, all their columns."""
    return judge(pages, rules, url, default).where("verdict = 'allow'").select(f"{ROW}.*")
