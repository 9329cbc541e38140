"""Column names: inflection rules on metadata; the data is not touched."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping

from pyspark.sql import DataFrame

# Nouns that do not follow the suffix rules.
IRREGULAR = {"person": "people", "man": "men", "child": "children", "sex": "sexes", "move": "moves",
             "ox": "oxen", "mouse": "mice", "louse": "lice", "quiz": "quizzes", "human": "humans"}
SAME = ("equipment", "information", "rice", "money", "species", "series", "fish", "sheep", "jeans", "news")
# Fixed values: (singular ending, plural ending), the first that fits is used.
ENDINGS = (
    (r"(matr|vert|ind)(?:ix|ex)$", r"\1ices", r"(matr)ices$", r"\1ix"),
    (r"(x|ch|ss|sh)$", r"\1es", r"(x|ch|ss|sh)es$", r"\1"),
    (r"([^aeiouy]|qu)y$", r"\1ies", r"([^aeiouy]|qu)ies$", r"\1y"),
    (r"(kni|wi|li)fe$", r"\1ves", r"(kni|wi|li)ves$", r"\1fe"),
    (r"([lr])f$", r"\1ves", r"([lr])ves$", r"\1f"),
    (r"sis$", "ses", r"(analy|ba|diagno|parenthe|progno|synop|the)ses$", r"\1sis"),
    (r"([ti])um$", r"\1a", r"([ti])a$", r"\1um"),
    (r"(buffal|tomat|potat)o$", r"\1oes", r"(buffal|tomat|potat)oes$", r"\1o"),
    (r"(bu|alias|status)s?$", r"\1", r"(alias|status)es$", r"\1"),
)


def underscore(name: str) -> str:
    name = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", name.strip())
    name = re.sub(r"([a-z\d])([A-Z])", r"\1_\2", name)
    return re.sub(r"[\s-]+", "_", name).lower()


def camelize(name: str) -> str:
    return re.sub(r"(?:^|_)(.)", lambda m: m.group(1).upper(), name)


def dasherize(name: str) -> str:
    return name.replace("_", "-")


def humanize(name: str) -> str:
    text = re.sub(r"_id$", "", name).replace("_", " ").lower()
    return text[:1].upper() + text[1:]


def titleize(name: str) -> str:
    return re.sub(r"\b('?\w)", lambda m: m.group(1).upper(), humanize(underscore(name)))


def parameterize(name: str, separator: str = "-") -> str:
    plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
    parts = re.findall(r"[A-Za-z0-9_-]+", plain)
    return re.sub(f"{re.escape(separator)}+", separator, separator.join(parts)).strip(separator).lower()


def _last_word(name: str, change) -> str:
    head, last = re.fullmatch(r"(.*?)([A-Za-z]*)", name, re.S).groups()
    return head + change(last)


def _cased(word: str, new: str) -> str:
    return new[:1].upper() + new[1:] if word[:1].isupper() else new


def pluralize(name: str) -> str:
    def change(word: str) -> str:
        low = word.lower()
        if not word or low in SAME or low in IRREGULAR.values():
            return word
        if low in IRREGULAR:
            return _cased(word, IRREGULAR[low])
        if re.search(r"(alias|status|bus)$", low):
            return word + "es"
        for one, many, _, _ in ENDINGS[:-1]:
            if re.search(one, word):
                return re.sub(one, many, word)
        return word if low.endswith("s") else word + "s"

    return _last_word(name, change)


def singularize(name: str) -> str:
    back = {many: one for one, many in IRREGULAR.items()}

    def change(word: str) -> str:
        low = word.lower()
        if not word or low in SAME or low in IRREGULAR:
            return word
        if low in back:
            return _cased(word, back[low])
        if re.search(r"(ss|sis|status|alias|bus)$", low):
            return word
        if re.search(r"(alias|status|bus)es$", low):
            return word[:-2]
        for _, _, many, one in ENDINGS:
            if re.search(many, word):
                return re.sub(many, one, word)
        return word[:-1] if low.endswith("s") else word

    return _last_word(name, change)


METHODS = {
    "underscore": underscore, "camelize": camelize, "dasherize": dasherize, "humanize": humanize,
    "titleize": titleize, "singularize": singularize, "pluralize": pluralize, "parameterize": parameterize,
}


def inflect_columns(df: DataFrame, method: str) -> DataFrame:
    """Apply one method to every column name; two names that become equal raise."""
    names = [METHODS[method](c) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"{method} makes column names collide: {names}")
    return df.toDF(*names)


def name_table(df: DataFrame, method: str = "underscore", suggestions: Mapping[str, str] | None = None) -> DataFrame:
    """(original, inflected, suggested) to choose names from."""
    suggestions = suggestions or {}
    rows = [(c, METHODS[method](c), suggestions.get(c, c)) for c in df.columns]
    return df.sparkSession.createDataFrame(rows, "original string, inflected string, suggested string")


def rename_from_table(df: DataFrame, table: DataFrame, choice: str = "inflected") -> DataFrame:
    chosen = {r["original"]: r[choice] for r in table.collect()}  # one row per column
    names = [chosen.get(c, c) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError("chosen names collide")
    return df.toDF(*names)
