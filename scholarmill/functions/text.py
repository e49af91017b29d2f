"""Cleaning of names, abstracts, DOIs and raw values, as Columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType, StringType

from scholarmill.schema import DOC_TYPES


@F.pandas_udf(StringType())
def strip_accents(text: pd.Series) -> pd.Series:
    """Letters without their accents; what isn't ASCII then goes. Spark has no Unicode normalisation of its own."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFD", x).encode("ascii", "ignore").decode())


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """HTML entities as characters, then ASCII only and trimmed; a null is an empty text."""
    import html

    return text.map(lambda x: "" if x is None else unicodedata.normalize("NFD", html.unescape(x)).encode("ascii", "ignore").decode().strip())


def _without_parentheses(c: Column) -> Column:
    c = F.regexp_replace(c, r"\([^()]*\)|\[[^\[\]]*\]", "")
    return F.regexp_replace(c, r"\(.*$", "")


def clean_person_name(name: Column, remove_parentheses: bool = True) -> Column:
    """Without accents, bracketed parts and ()[].; -- commas and spaced dashes become dashes, " & " becomes "&"."""
    c = strip_accents(name)
    if remove_parentheses:
        c = _without_parentheses(c)
    c = F.regexp_replace(c, r"[()\[\].;]", "")
    c = F.regexp_replace(c, r" - |- | -|,", "-")
    return F.trim(F.replace(c, F.lit(" & "), F.lit("&")))


def clean_institution_name(name: Column, remove_parentheses: bool = True) -> Column:
    """Without accents and bracketed parts; separators become spaces, " & " becomes " and ", white space is single."""
    c = strip_accents(name)
    if remove_parentheses:
        c = _without_parentheses(c)
    c = F.replace(c, F.lit(" & "), F.lit(" and "))
    c = F.regexp_replace(c, r"[()\[\].;,]| - |- | -", " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def standard_doi(doi: Column) -> Column:
    """Lower case, without the resolver's address."""
    return F.regexp_replace(F.lower(F.trim(doi)), r"^(https?://(dx\.)?doi\.org/|doi:\s*)", "")


def abstract_text(index: Column) -> Column:
    """The text of a map from words to their positions; empty for a null."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " "), F.lit(""))


def to_int(c: Column) -> Column:
    return F.trim(c).try_cast("long")


def to_float(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def to_bool(c: Column) -> Column:
    """true and false in three spellings, 0 and 1; else null."""
    return F.when(c.isin("true", "True", "TRUE", "1"), F.lit(True)).when(c.isin("false", "False", "FALSE", "0"), F.lit(False))


def doc_type(name: Column) -> Column:
    """The code of a document type; an empty text for others."""
    table = F.create_map(*[F.lit(x) for pair in DOC_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, name), F.lit(""))


def openalex_id(c: Column) -> Column:
    """The number at the end of an identifier's address."""
    return F.regexp_extract(c, r"([0-9]+)/?$", 1).try_cast("long")


def name_parts(full: Column) -> Column:
    """(LastName, FirstName, MiddleName) of "First Middle Last" or "Last, First Middle"; titles and suffixes are left out."""
    c = F.trim(F.regexp_replace(full, r"(?i)^(dr|prof|mr|mrs|ms)\.?\s+|,?\s+(jr|sr|ii|iii|iv|phd|md)\.?$", ""))
    turned = F.when(c.contains(","), F.trim(F.concat_ws(" ", F.trim(F.substring_index(F.substring_index(c, ",", 2), ",", -1)), F.trim(F.substring_index(c, ",", 1))))).otherwise(c)
    comma = F.when(c.contains(","), F.size(F.split(F.trim(F.substring_index(c, ",", 1)), r"\s+"))).otherwise(F.lit(1))
    words = F.split(turned, r"\s+")
    n = F.size(words)
    last = F.array_join(F.slice(words, F.greatest(F.lit(1), n - comma + 1), comma), " ")
    first = F.when(n > comma, F.get(words, F.lit(0))).otherwise(F.lit(""))
    middle = F.when(n > comma + 1, F.array_join(F.slice(words, F.lit(2), n - comma - 1), " ")).otherwise(F.lit(""))
    return F.struct(last.alias("LastName"), first.alias("FirstName"), middle.alias("MiddleName"))


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the longest common subsequence by the sum of lengths; Spark's levenshtein has substitutions of cost 1 and isn't the same."""

    def ratio(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        if not x and not y:
            return 1.0
        at: dict[str, int] = {}
        for i, c in enumerate(x):
            at[c] = at.get(c, 0) | (1 << i)
        full = (1 << len(x)) - 1
        s = full
        for c in y:
            u = s & at.get(c, 0)
            s = ((s + u) | (s - u)) & full
        return 2.0 * (len(x) - s.bit_count()) / (len(x) + len(y))

    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="float64")
