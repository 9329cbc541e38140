"""The corpus queries: each applies one operator to its whole table and states, where SQL can, what it must return."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm import chat, decontaminate, html, katz, mixing, packing, quality, resample, simhash, substrings, tokens, trie, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_chat_format")
def op1(spark, folder):
    return chat.formatted(table(spark, folder, "conversations"))


RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]

OP2_SQL = """
WITH p AS (
  SELECT page_id, regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1) AS raw,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
q AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM p),
r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                      ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
SELECT page_id, host, path,
       (SELECT h || p FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
        ORDER BY length(h || p) DESC LIMIT 1) AS rule,
       coalesce((SELECT v FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
        ORDER BY length(h || p) DESC LIMIT 1), 'allow') AS verdict
FROM q"""


@query("op2_url_filter", OP2_SQL)
def op2(spark, folder):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    out = urls.judge(table(spark, folder, "pages"), rules)
    return out.select("_llm_row.page_id", "host", "path", "rule", "verdict")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('11:' || coalesce(doc_id::VARCHAR, 'null')) AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size) AS cap,
             [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY source),
t AS (SELECT *, sum(source_size) OVER () AS total,
             coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM s),
l AS (SELECT (any_value(total) - coalesce(sum(cap) FILTER (WHERE cap / w < (total - before) / rest), 0))
             / sum(w) FILTER (WHERE NOT (cap / w < (total - before) / rest)) AS level FROM t),
f AS (SELECT source, source_size, least(w * level, cap) AS target, least(w * level, cap) / greatest(source_size, 1) AS epochs FROM s, l),
g AS (SELECT d.doc_id, d.size, d.o, f.*, floor(epochs) AS whole, (epochs - floor(epochs)) * f.source_size AS part
      FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source),
h AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY o, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM g)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN part > 0 AND start + size / 2.0 <= part THEN 1 ELSE 0 END))::BIGINT AS taken FROM h"""


@query("op3_mix_sources", OP3_SQL)
def op3(spark, folder):
    out = mixing.copies(table(spark, folder, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op4_substring_dedup")
def op4(spark, folder):
    return substrings.deduplicated(table(spark, folder, "documents"))


@query("op5_simhash_groups")
def op5(spark, folder):
    out = simhash.grouped(table(spark, folder, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op6_html_text")
def op6(spark, folder):
    return html.extracted(table(spark, folder, "pages"))


@query("op7_token_files")
def op7(spark, folder):
    return tokens.encoded(table(spark, folder, "documents"), vocabulary())


@query("op8_benchmark_passages")
def op8(spark, folder):
    return decontaminate.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op9_katz_scores")
def op9(spark, folder):
    return katz.scores(table(spark, folder, "documents"))


def _op10_sql() -> str:
    """The measures, votes and rounds of ``quality`` in SQL; the rounds are a recursive table of one row each."""
    gone = r"[\x20\x09-\x0D0-9.,;:!?()\[\]{}''" + r'"' + r"_/\\+=@^~`#*$%&|<>-]"
    at_least = lambda x: f"greatest({x}, 1)"
    symbols, ending, shouts = (f"{c} / {at_least('n_words')}" for c in ("n_symbols", "n_symbol_words", "n_shouts"))
    lines, again, long_ = f"n_dup_lines / {at_least('n_lines')}", f"n_repeat_words / {at_least('n_words')}", f"word_chars / {at_least('n_words')}"
    upper, marks, letters = f"n_upper / {at_least('word_chars')}", f"n_marks / {at_least('n_words')}", f"n_letters / {at_least('word_chars')}"
    tests = {
        "length": ("n_words < 50", "n_words >= 100"), "symbols": (f"{symbols} > 0.3", f"{symbols} <= 0.05"),
        "symbol_words": (f"{ending} > 0.2", f"{ending} <= 0.02"), "letters": (f"{letters} < 0.6", f"{letters} >= 0.85"),
        "repeated_lines": (f"{lines} > 0.3", f"n_lines >= 2 AND {lines} <= 0.1"), "repeated_words": (f"{again} > 0.5", f"{again} <= 0.2"),
        "capitals": (f"{upper} > 0.5", f"{upper} <= 0.15"), "shouts": (f"{shouts} > 0.2", f"{shouts} <= 0.02"),
        "sentences": (f"{marks} > 0.7 AND n_words >= 20 OR {marks} < 0.005 AND n_words >= 200", f"{marks} >= 0.02 AND {marks} <= 0.4"),
        "word_length": (f"{long_} < 2.5 OR {long_} > 12", f"{long_} >= 3.5 AND {long_} <= 9"),
    }
    n = range(len(quality.RULES))
    votes = ", ".join(f"CASE WHEN {tests[r][0]} THEN -1 WHEN {tests[r][1]} THEN 1 ELSE 0 END AS v{i}" for i, r in enumerate(quality.RULES))
    odds = "ln(p / (1 - p))" + "".join(f" + CASE v{i} WHEN 1 THEN ln((1 - g{i}) / (1 - b{i})) WHEN -1 THEN ln(g{i} / b{i}) ELSE 0 END" for i in n)
    q = quality
    next_ = lambda part, chance, share, i: (
        f"(coalesce(sum({part}) FILTER (WHERE v{i} = -1), 0) + {chance * share * q.BELIEF} * any_value(n)) / (coalesce(sum({part}) FILTER (WHERE v{i} <> 0), 0) + {share * q.BELIEF} * any_value(n))")
    step = ", ".join([next_("c * q", q.DOWN_GOOD, q.PRIOR, i) for i in n] + [next_("c * (1 - q)", q.DOWN_BAD, 1 - q.PRIOR, i) for i in n])
    names = ", ".join([f"g{i}" for i in n] + [f"b{i}" for i in n])
    start = ", ".join([f"{q.DOWN_GOOD}::DOUBLE"] * len(n) + [f"{q.DOWN_BAD}::DOUBLE"] * len(n))
    keys = ", ".join(f"v{i}" for i in n)
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
x AS (SELECT r, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) AS u(i)),
k AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM x),
z AS (SELECT r, count(DISTINCT i + o) AS n_repeat_words FROM k, (VALUES (0), (1), (2)) AS s(o) WHERE c > 1 GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
  length(t) - length(regexp_replace(t, '[.!?]', '', 'g')) AS n_marks, length(regexp_replace(t, '{gone}', '', 'g')) AS n_letters,
  len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&|<>]$'))) AS n_symbol_words, (length(t) - length(replace(t, '!!', ''))) // 2 AS n_shouts FROM w LEFT JOIN z USING (r)),
v AS (SELECT *, {votes} FROM m), pat AS (SELECT {keys}, count(*)::DOUBLE AS c FROM v GROUP BY ALL), tot AS (SELECT sum(c) AS n FROM pat),
em(it, p, {names}) AS (
  SELECT 0, {q.PRIOR}::DOUBLE, {start}
  UNION ALL
  SELECT it + 1, (sum(c * q) + {q.PRIOR * q.BELIEF} * any_value(n)) / ((1 + {q.BELIEF}) * any_value(n)), {step}
  FROM (SELECT em.it, pat.*, tot.n, 1 / (1 + exp(-({odds}))) AS q FROM em, pat, tot WHERE em.it < {q.ROUNDS}) GROUP BY it),
f AS (SELECT v.*, 1 / (1 + exp(-({odds}))) AS q, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS failed FROM v, (SELECT * FROM em WHERE it = {q.ROUNDS}))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed, NOT failed AND q >= {q.KEEP_AT} AS kept, round(q, 6) AS posterior FROM f"""


@query("op10_quality_rules", _op10_sql())
def op10(spark, folder):
    out = quality.judge(table(spark, folder, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


def _crc32(numbers: str) -> str:
    """CRC-32 of a list of bytes in SQL, bit by bit."""
    bit = "CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END"
    byte = f"list_reduce(list_concat([xor(a, x)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: {bit})"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {numbers}), lambda a, x: {byte}), 4294967295)"


OP11_SQL = rf"""
WITH low AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
goal AS (SELECT translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark),
dw AS (SELECT r, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM low),
tw AS (SELECT unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM goal),
words AS (SELECT w, hex(w) AS h FROM (SELECT w FROM dw UNION SELECT w FROM tw)),
crc AS (SELECT w, {_crc32("list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT)")} % 10000 AS b FROM words),
per AS (SELECT r, b, count(*) AS n FROM dw JOIN crc USING (w) GROUP BY 1, 2),
s AS (SELECT b, sum(n)::DOUBLE AS s FROM per GROUP BY 1), t AS (SELECT b, count(*)::DOUBLE AS t FROM tw JOIN crc USING (w) GROUP BY 1),
a AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS big_s, (SELECT coalesce(sum(t), 0) FROM t) AS big_t),
gain AS (SELECT s.b, floor(1000 * ln((coalesce(t, 0) + 1) * (big_s + 10000) / ((s + 1) * (big_t + 10000))))::BIGINT AS g FROM s LEFT JOIN t ON s.b = t.b, a),
m AS (SELECT low.r, doc_id, coalesce(sum(n), 0)::BIGINT AS n_features, coalesce(sum(n * g), 0)::BIGINT AS weight
      FROM low LEFT JOIN per ON low.r = per.r LEFT JOIN gain ON per.b = gain.b GROUP BY 1, 2),
z AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score FROM m),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS rank, 10 * count(*) OVER () // 100 AS most FROM z WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= most THEN rank END AS rank FROM z LEFT JOIN k USING (r)"""


@query("op11_resample", OP11_SQL)
def op11(spark, folder):
    out = resample.resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = f"""
WITH c AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own
           FROM conversations GROUP BY 1),
h AS (SELECT *, coalesce({_crc32("list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)")} % 6, 0)::INT AS h FROM c),
p AS (SELECT h.conv_id, list_concat(coalesce(b.own[1:h.h], []), h.own[h.h + 1:]) AS path FROM h LEFT JOIN c AS b ON b.conv_id = h.conv_id - h.conv_id % 100),
x AS (SELECT conv_id, path[1:d] AS node, d, len(path) AS total FROM p, unnest(range(0, len(path) + 1)) AS u(d)),
n AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE d = total) AS ends FROM x GROUP BY 1, 2),
k AS (SELECT node[1:d - 1] AS node, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
o AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.d > 0 THEN (n_convs - 1) * length(n.node[n.d].t) ELSE 0 END AS saved FROM n LEFT JOIN k ON n.node = k.node AND n.d = k.d),
g AS (SELECT node[1:e] AS node, e AS d, sum((n_children = 0)::INT) AS n_leaves, sum(saved) AS saved_tokens FROM o, unnest(range(0, d + 1)) AS u(e) GROUP BY 1, 2)
SELECT o.conv_id, o.d::BIGINT AS depth, up.conv_id AS parent_conv_id, o.n_convs, o.n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens,
       sha256(coalesce(o.ends, '')) AS ends_sha256
FROM o JOIN g ON o.node = g.node AND o.d = g.d LEFT JOIN n AS up ON up.d = o.d - 1 AND up.node = o.node[1:o.d - 1]"""


@query("op12_prefix_trie", OP12_SQL)
def op12(spark, folder):
    out = trie.trie(table(spark, folder, "conversations"))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@query("op13_packing")
def op13(spark, folder):
    return packing.packed(table(spark, folder, "documents"), vocabulary())
