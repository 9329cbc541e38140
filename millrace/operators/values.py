"""Value standardisation: type detection, cleaning rules, corrections, votes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType, StringType

from millrace.operators import columns as C
from millrace.quantiles import column_modes, literal

# Formats accepted for dates and timestamps.
DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "MMM d, yyyy", "d MMM yyyy", "yyyyMMdd", "M/d/yyyy")
DATETIME_FORMATS = (
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm",
    "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd-MM-yyyy HH:mm:ss", "dd-MM-yyyy HH:mm", "yyyyMMdd_HHmm",
)
# Patterns that make a column a date or a timestamp.
DATE_PATTERN = r"\d{4}-\d{2}-\d{2}"
DATETIME_PATTERNS = (
    r"\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}",
    r"\d{2}/\d{2}/\d{4}\s+\d{2}:\d{2}",
    r"\d{2}-\d{2}-\d{4}\s+\d{2}:\d{2}",
    r"\d{8}_\d{4}",
)
# What is cut out of a suggested term.
RESPONSE_NOISE = (
    r"(?i)standardization", r"(?i)standardized term:\s*", r"(?i)the standard name for (?:the\s*)?",
    r"\.\s+", r"->", r"[\"']", r"\(.*?\)", r"\[.*?\]",
)


def detect_types(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], sample: int | None = None,
                 compat: bool = False) -> DataFrame:
    """(column, kind) from all non-null values, or only the first ``sample`` along ``order_by``.

    A column is a timestamp if one of the shapes of timestamps makes up more than half of it.

    Kinds: email, phone, numeric, date, datetime, text. Dates are tested before phone numbers,
    because a date has as many digits as a phone number; ``compat`` tests phones first.
    """
    out = None
    for c in columns:
        v = df.where(F.col(c).isNotNull())
        v = v.orderBy(*order_by).limit(sample) if sample else v
        v = v.select(F.trim(F.col(c).cast("string")).alias("v"))
        digits = F.length(F.regexp_replace("v", r"\D", ""))
        number = F.regexp_replace("v", "[,$]", "").try_cast("double")
        share = lambda test: F.avg(F.coalesce(test, F.lit(False)).cast("int"))
        r = v.agg(
            share(F.contains("v", F.lit("@"))).alias("email"), share(digits.between(7, 15)).alias("phone"),
            F.when(F.count_if(number.isNull()) == 0, share(number != 0)).alias("numeric"),
            share(F.col("v").rlike(DATE_PATTERN)).alias("date"), F.greatest(*[share(F.col("v").rlike(p)) for p in DATETIME_PATTERNS]).alias("datetime"),
        )
        email, phone = (F.col("email") > 0.7), (F.col("phone") > 0.7)
        date, datetime = (F.col("date") > 0.5), (F.col("datetime") > 0.5)
        if compat:
            kind = F.when(email, "email").when(phone, "phone").when(F.col("numeric") > 0.8, "numeric").when(
                date, "date").when(datetime, "datetime").otherwise("text")
        else:
            kind = F.when(email, "email").when(datetime, "datetime").when(date, "date").when(phone, "phone").when(
                F.col("numeric") > 0.8, "numeric").otherwise("text")
        one = r.select(F.lit(c).alias("column"), kind.alias("kind"))
        out = one if out is None else out.unionByName(one)
    return out


def standard_number(c: Column) -> Column:
    """``$1,200`` -> ``1200.0`` as text; anything else is kept."""
    return F.coalesce(F.regexp_replace(c, "[,$]", "").try_cast("double").cast("string"), c)


def standard_email(c: Column) -> Column:
    return F.lower(F.trim(c))


def standard_phone(c: Column) -> Column:
    """Digits only, when there are at least 7; else kept."""
    digits = F.regexp_replace(c, r"\D", "")
    return F.when(F.length(digits) >= 7, digits).otherwise(c)


def _parsed(c: Column, formats: Sequence[str]) -> Column:
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)) for f in formats])


def standard_date(c: Column) -> Column:
    return F.coalesce(F.date_format(_parsed(c, DATE_FORMATS + DATETIME_FORMATS), "dd-MM-yyyy"), c)


def standard_datetime(c: Column) -> Column:
    return F.coalesce(F.date_format(_parsed(c, DATETIME_FORMATS + DATE_FORMATS), "dd-MM-yyyy HH-mm-ss"), c)


def split_words(c: Column) -> Column:
    """camelCase, snake_case and kebab-case to lower-case words."""
    c = F.regexp_replace(c, "(?<=[a-z])(?=[A-Z])", " ")
    return F.lower(F.regexp_replace(c, r"[_\-]+", " "))


def clean_text(c: Column) -> Column:
    """Words, lower case, no punctuation, single spaces; NULL -> ''."""
    c = F.regexp_replace(F.trim(split_words(c)), r"[^\p{L}\p{N}_\s]", "")
    return F.coalesce(F.regexp_replace(c, r"\s+", " "), F.lit(""))


RULES = {
    "email": standard_email, "phone": standard_phone, "numeric": standard_number, "date": standard_date,
    "datetime": standard_datetime, "text": lambda c: F.trim(split_words(c)),
}


def auto_standardize(df: DataFrame, order_by: Sequence[str], columns: Sequence[str] | None = None,
                     sample: int | None = None, compat: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """Detect each string column's kind and apply its rule, in one projection."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, StringType)]
    columns = [c for c in columns or texts if c in texts]
    kinds = {r["column"]: r["kind"] for r in detect_types(df, columns, order_by, sample, compat).collect()}
    return df.withColumns({c: RULES[k](F.col(c)) for c, k in kinds.items()}), kinds


def standard_strings(df: DataFrame) -> DataFrame:
    """All string cells: trim, lower, space and ``/`` to ``_``."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, StringType)]
    return df.withColumns({c: F.translate(F.lower(F.trim(F.col(f"`{c}`"))), " /", "__") for c in texts})


def distinct_terms(df: DataFrame, column: str) -> DataFrame:
    """(term): distinct, trimmed, not empty."""
    return df.select(F.trim(column).alias("term")).where("term <> ''").distinct()


def word_corrections(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, fixed) for words outside the vocabulary (word, freq) with a neighbour in it.

    Two words are one edit apart only if deleting at most one letter from each gives a common
    string, so an equi-join on those strings finds every pair; Levenshtein checks it. Of several
    neighbours the most frequent wins, then the smallest.
    """
    def cuts(word: str) -> Column:
        n = F.length(word)
        less = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(
            F.substr(F.col(word), F.lit(1), i - 1), F.substr(F.col(word), i + 1)))
        return F.explode(F.array_distinct(F.concat(F.array(F.col(word)), less)))

    unknown = words.select(F.lower("word").alias("word")).distinct().where(
        (F.length("word") > 2) & ~F.col("word").rlike(r"^\d+$") & ~F.col("word").rlike(r"^(?=.*\d)[a-z0-9\-_]+$"))
    unknown = unknown.join(vocabulary.select("word"), "word", "left_anti")
    left = unknown.select("word", cuts("word").alias("cut"))
    right = vocabulary.select(F.col("word").alias("known"), "freq", cuts("word").alias("cut"))
    near = left.join(right, "cut").where(F.levenshtein("word", "known", 1) >= 0)
    return near.groupBy("word").agg(F.min(F.struct((-F.col("freq")).alias("f"), F.col("known")))["known"].alias("fixed"))


def term_corrections(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, fixed): every word of each distinct term corrected, UPPER and Title case kept."""
    words = terms.select("term", F.posexplode(F.split(F.trim("term"), r"\s+")).alias("at", "word"))
    fixes = word_corrections(words, vocabulary).select(F.col("word").alias("low"), "fixed")
    joined = words.withColumn("low", F.lower("word")).join(fixes, "low", "left")
    word = F.when(F.col("fixed").isNull(), F.col("word")).when(
        (F.col("word") == F.upper("word")) & (F.lower("word") != F.upper("word")), F.upper("fixed")
    ).when(F.col("word") == F.initcap("word"), F.initcap("fixed")).otherwise(F.col("fixed"))
    # One group is the words of one term: bounded by the length of its text.
    parts = joined.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("at", word.alias("w")))).alias("p"))
    return parts.select("term", F.array_join("p.w", " ").alias("fixed"))


def correct_spelling(df: DataFrame, column: str, vocabulary: DataFrame) -> DataFrame:
    """Correct a column through its distinct terms only."""
    terms = distinct_terms(df, column)
    return C.lookup(df.withColumn(column, F.trim(column)), column, term_corrections(terms, vocabulary), "term", "fixed")


def standardize_column(df: DataFrame, column: str, corrections: DataFrame) -> DataFrame:
    """Apply a (term, fixed) table to a column."""
    return C.lookup(df, column, corrections, "term", "fixed")


def clean_response(c: Column) -> Column:
    for pattern in RESPONSE_NOISE:
        c = F.regexp_replace(c if isinstance(c, Column) else F.col(c), pattern, "")
    return F.trim(F.regexp_replace(F.trim(c), r"\s+", " "))


def majority_vote(responses: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(term, fixed) from candidate rows (term, response).

    Cleaned responses equal to the term or to an ``existing`` code do not count. The most
    frequent one wins (smallest on ties); of several terms that want the same code the one with
    most votes gets it (then the smallest), the others keep their term.
    """
    every = responses.select("term").distinct()
    votes = responses.select("term", clean_response(F.trim("response")).alias("code")).where(
        (F.col("code") != "") & (F.col("code") != F.col("term")))
    if existing is not None:
        votes = votes.join(existing.toDF("code").distinct(), "code", "left_anti")
    tally = votes.groupBy("term", "code").agg(F.count(F.lit(1)).alias("n"))
    best = tally.groupBy("term").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("code"))).alias("b"))
    owner = best.groupBy(F.col("b.code").alias("code")).agg(F.min(F.struct(F.col("b.n").alias("n"), F.col("term")))["term"].alias("term"))
    return every.join(owner, "term", "left").select("term", F.coalesce("code", "term").alias("fixed"))


def standardize_missing(df: DataFrame, column: str, reference: str, mapping: DataFrame) -> DataFrame:
    """Known values take the mapped term of the reference column; missing values take the mapped
    term too, else the mean of a numeric column or the mode of another."""
    kind = df.schema[column].dataType
    if isinstance(kind, NumericType):
        spare = F.lit(df.agg(F.avg(column)).first()[0])
    else:
        spare = literal(column_modes(df, [column])[column], kind)
    side = mapping.select(F.col("term").alias("_t"), F.col("fixed").alias("_f"))
    joined = df.join(side, F.col(reference) == F.col("_t"), "left")
    mapped = F.col("_f").try_cast(kind) if isinstance(kind, NumericType) else F.col("_f")
    value = F.coalesce(mapped, F.col(column), spare)
    return joined.select(*[value.alias(c) if c == column else F.col(c) for c in df.columns])
