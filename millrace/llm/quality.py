"""Quality rules under weak supervision.

Every rule votes good (1), bad (-1) or abstains (0) on a document. Expectation-maximisation over the vote patterns
estimates how often each rule votes either way on good and on bad documents; a document is kept where its posterior
probability of being good reaches ``KEEP_AT``. Texts are measured by array functions inside the row, so nothing is shuffled
but one count per vote pattern, of which there are at most 3 to the power of the number of rules.

Null texts count as empty. Repeated rows are judged alike. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.common import GAP, ROW, TEXT, carried, words
from millrace.session import cut_lineage

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_letters",
            "n_symbol_words", "n_shouts"]
RULES = ["length", "symbols", "symbol_words", "letters", "repeated_lines", "repeated_words", "capitals", "shouts", "sentences", "word_length"]
SYMBOLS, MARKS = "#*$%&|<>", ".!?"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEEP_AT = 0.5
ROUNDS = 60
#: Belief before any document is seen: share of good documents, chance of a bad vote on a good and on a bad document. It weighs
#: as much as ``BELIEF`` times the documents, so that a rule which alone finds its kind of bad text is not taken for a bad rule.
PRIOR, DOWN_GOOD, DOWN_BAD, BELIEF = 0.9, 0.005, 0.4, 1.0


def _removed(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``ROW`` (the whole input row) and the measures of its text, all long."""
    t = F.col(TEXT)
    df = carried(docs, text).withColumn("_llm_words", words(t))
    n = F.size("_llm_words")
    # Three-word windows as (hash, start) in one long; equal neighbours after sorting are candidates, whose
    # full hashes are compared again, since the start takes bits away from the hash.
    bits = F.ceil(F.log2(n + F.lit(1))).cast("int")
    w = lambda i: F.get("_llm_words", i)
    window = lambda i: F.xxhash64(w(i), w(i + 1), w(i + 2))
    left = lambda a, b: F.call_function("shiftleft", a, b)
    right = lambda a, b: F.call_function("shiftright", a, b)
    starts = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumns({"_llm_bits": bits, "_llm_lines": lines})
    df = df.withColumn("_llm_packed", F.sort_array(F.transform(
        starts, lambda i: left(window(i), F.col("_llm_bits")).bitwiseOR(i.cast("long")))))
    near = lambda name, j: right(F.get(name, j), F.col("_llm_bits"))
    df = df.withColumn("_llm_near", F.filter("_llm_packed", lambda v, j: (
        right(v, F.col("_llm_bits")).eqNullSafe(near("_llm_packed", j + 1))
        | right(v, F.col("_llm_bits")).eqNullSafe(near("_llm_packed", j - 1)))))
    mask = left(F.lit(1).cast("long"), F.col("_llm_bits")) - 1
    df = df.withColumn("_llm_found", F.sort_array(F.transform("_llm_near", lambda v: F.struct(
        window(v.bitwiseAND(mask).cast("int")).alias("h"), v.bitwiseAND(mask).cast("int").alias("i")))))
    df = df.withColumn("_llm_twice", F.sort_array(F.transform(
        F.filter("_llm_found", lambda s, j: (
            s["h"].eqNullSafe(F.get("_llm_found", j + 1)["h"]) | s["h"].eqNullSafe(F.get("_llm_found", j - 1)["h"]))),
        lambda s: s["i"])))
    gaps = F.transform("_llm_twice", lambda i, j: F.least(F.coalesce(F.get("_llm_twice", j + 1) - i, F.lit(3)), F.lit(3)).cast("long"))
    marks = _removed(t, MARKS)
    symbols = _removed(t, SYMBOLS)
    return df.select(
        ROW, n.cast("long").alias("n_words"),
        F.length(F.translate(t, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        (F.size("_llm_lines") - F.size(F.array_distinct("_llm_lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"),
        F.size("_llm_lines").cast("long").alias("n_lines"),
        _removed(t, CAPITALS).cast("long").alias("n_upper"),
        marks.cast("long").alias("n_marks"),
        F.length(F.translate(t, " \t\n\x0b\f\r0123456789.,;:!?()[]{}'\"-_/\\+=@^~`" + SYMBOLS, "")).cast("long").alias("n_letters"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>](?![^\x20\x09-\x0D])")).cast("long").alias("n_symbol_words"),
        F.regexp_count(t, F.lit(r"!!")).cast("long").alias("n_shouts"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def votes() -> dict[str, Column]:
    """One vote per rule from the measures."""
    n = F.col("n_words")

    def per(a: str, b: str) -> Column:
        return F.col(a) / F.greatest(F.col(b), F.lit(1))

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    symbols, lines, again = per("n_symbols", "n_words"), per("n_dup_lines", "n_lines"), per("n_repeat_words", "n_words")
    long_, upper, marks, letters = per("word_chars", "n_words"), per("n_upper", "word_chars"), per("n_marks", "n_words"), per("n_letters", "word_chars")
    return {
        "length": vote(n < 50, n >= 100),
        "symbols": vote(symbols > 0.3, symbols <= 0.05),
        "symbol_words": vote(per("n_symbol_words", "n_words") > 0.2, per("n_symbol_words", "n_words") <= 0.02),
        "shouts": vote(per("n_shouts", "n_words") > 0.2, per("n_shouts", "n_words") <= 0.02),
        "repeated_lines": vote(lines > 0.3, (F.col("n_lines") >= 2) & (lines <= 0.1)),
        "repeated_words": vote(again > 0.5, again <= 0.2),
        "word_length": vote((long_ < 2.5) | (long_ > 12), (long_ >= 3.5) & (long_ <= 9)),
        "capitals": vote(upper > 0.5, upper <= 0.15),
        "sentences": vote((marks > 0.7) & (n >= 20) | (marks < 0.005) & (n >= 200), (marks >= 0.02) & (marks <= 0.4)),
        "letters": vote(letters < 0.6, letters >= 0.85),
    }


@dataclass(frozen=True)
class Model:
    """Share of good documents; per rule its chance of a good and of a bad vote, given a good and given a bad document."""

    prior: float
    chances: dict[str, tuple[float, float, float, float]]

    def log_odds(self) -> Column:
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for rule, (up_good, down_good, up_bad, down_bad) in self.chances.items():
            v = F.col(f"_llm_v_{rule}")
            total = total + F.when(v == 1, math.log(up_good / up_bad)).when(v == -1, math.log(down_good / down_bad)).otherwise(0.0)
        return total

    def posterior(self) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.log_odds()))


def _with_votes(df: DataFrame) -> DataFrame:
    return df.withColumns({f"_llm_v_{rule}": vote for rule, vote in votes().items()})


def fit(measures: DataFrame) -> Model:
    """Expectation-maximisation over the vote patterns of all documents.

    The pattern counts (at most 3 to the power of the number of rules) are one array in one row, and the rounds a fold over it.
    A rule that abstains says nothing. Both classes are estimated apart, so one bad vote is not outweighed by rules that
    vote good on everything. Without documents the belief stands as it is.
    """
    names = [f"_llm_v_{rule}" for rule in RULES]
    patterns = _with_votes(measures).groupBy(*names).agg(F.count(F.lit(1)).cast("double").alias("c"))
    listed = patterns.agg(F.array_sort(F.collect_list(F.struct("c", F.array(*names).alias("v")))).alias("patterns"), F.sum("c").alias("n"))
    each = F.sequence(F.lit(0), F.lit(len(RULES) - 1))
    start = F.struct(F.lit(PRIOR).alias("prior"), F.array_repeat(F.lit(DOWN_GOOD), len(RULES)).alias("good"),
                     F.array_repeat(F.lit(DOWN_BAD), len(RULES)).alias("bad"))

    def total(rows: Column, value) -> Column:
        return F.aggregate(rows, F.lit(0.0), lambda a, r: a + value(r))

    def posteriors(state: Column) -> Column:
        weigh = lambda v, j: (
            F.when(v == 1, F.ln((1 - state["good"][j]) / (1 - state["bad"][j])))
            .when(v == -1, F.ln(state["good"][j] / state["bad"][j])).otherwise(0.0))
        odds = lambda r: F.ln(state["prior"] / (1 - state["prior"])) + F.aggregate(
            F.transform(r["v"], weigh), F.lit(0.0), lambda a, x: a + x)
        return F.transform("patterns", lambda r: F.struct(
            r["v"].alias("v"), (r["c"] / (1 + F.exp(-odds(r)))).alias("g"), (r["c"] / (1 + F.exp(odds(r)))).alias("b")))

    def estimated(rows: Column) -> Column:
        belief = F.col("n") * BELIEF

        def down(part: str, chance: float, share: float) -> Column:
            return F.transform(each, lambda j: (
                total(rows, lambda r: F.when(r["v"][j] == -1, r[part]).otherwise(0.0)) + chance * share * belief
            ) / (total(rows, lambda r: F.when(r["v"][j] != 0, r[part]).otherwise(0.0)) + share * belief))

        prior = (total(rows, lambda r: r["g"]) + PRIOR * belief) / (F.col("n") + belief)
        return F.struct(prior.alias("prior"), down("g", DOWN_GOOD, PRIOR).alias("good"), down("b", DOWN_BAD, 1 - PRIOR).alias("bad"))

    # A one-element array binds the posteriors to a name, so that they are computed once a round.
    state = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda state, _: F.transform(F.array(posteriors(state)), estimated)[0])
    got = listed.where("n > 0").select(state.alias("s")).first()
    prior, good, bad = (PRIOR, [DOWN_GOOD] * len(RULES), [DOWN_BAD] * len(RULES)) if got is None else got[0]
    return Model(prior, {r: (1 - g, g, 1 - b, b) for r, g, b in zip(RULES, good, bad)})


def judged(measures: DataFrame, model: Model) -> DataFrame:
    """The measures with ``base_failed``, ``posterior`` and ``kept``."""
    df = _with_votes(measures).withColumns({"base_failed": base_failed(), "posterior": model.posterior()})
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP_AT)).drop(*[f"_llm_v_{r}" for r in RULES])


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, measures, base_failed, posterior, kept) per document; the measures are written once and read twice."""
    table = cut_lineage(measured(docs.select(key, text), text).select(F.col(ROW)[key].alias(key), *MEASURES))
    return judged(table, fit(table))


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that the rules accept, all their columns; documents are written once beside their measures."""
    table = cut_lineage(measured(docs, text))
    return judged(table, fit(table)).where("kept").select(f"{ROW}.*")
