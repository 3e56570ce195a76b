"""Text functions as column expressions; NFKC is the one pandas UDF, as Spark has no such function."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD = r"[\p{L}\p{N}_'-]+"


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def fold(c: Column, lower: bool = True) -> Column:
    """Straight quotes and dashes, single spaces, trimmed, and lower case."""
    c = F.translate(c, "’‘“”–— ", "''\"\"-- ")
    c = F.trim(F.regexp_replace(c, r"[\s ]+", " "))
    return F.lower(c) if lower else c


def normalize(c: Column, lower: bool = True) -> Column:
    return fold(nfkc(c), lower)


def devanagari_digits(c: Column) -> Column:
    return F.translate(c, "०१२३४५६७८९", "0123456789")


def mixed_script(c: Column) -> Column:
    return c.rlike(r"[ऀ-ॿ]") & c.rlike("[A-Za-z]")


def tokens(c: Column) -> Column:
    """Lower-case words of two characters or more."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD[:-1] + "{2,}"), F.lit(0))


#: Patterns of exact-match tokens: fixed values.
EXACT = (
    r"\b[A-Z]{2,}\b",
    r"[\w.-]+@[\w.-]+",
    r"\b\d{4}[-/.]\d{1,2}[-/.]\d{1,2}\b",
    r"\b\d{1,2}/\d{1,2}/\d{2,4}\b",
    r"\b(?:19|20)\d{2}\b",
    r"(?i)NPR\s*[\d,]+(?:\.\d+)?",
    r"(?i)Rs\.?\s*[\d,]+(?:\.\d+)?",
    r"\$[\d,]+(?:\.\d+)?",
    r"[A-Za-z0-9_-]{28}",
    r"\b(?:[A-Z][a-z]+\s){1,3}[A-Z][a-z]+\b",
    r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b",
)
#: The same patterns in forms that find the same matches at less cost: no start is tried within a run that was tried, and
#: no word edge where the first character does not fit; with what the lower-case text must hold for any.
QUICK = (
    (r"(?=[A-Z])\b[A-Z]{2,}\b", None),
    (r"(?<![\w.-])[\w.-]++@[\w.-]+", "@"),
    (r"(?=\d)\b\d{4}[-/.]\d{1,2}[-/.]\d{1,2}\b", None),
    (r"(?=\d)\b\d{1,2}/\d{1,2}/\d{2,4}\b", "/"),
    (r"(?=[12])\b(?:19|20)\d{2}\b", None),
    (EXACT[5], "npr"),
    (EXACT[6], "rs"),
    (EXACT[7], "$"),
    (r"(?:(?<![A-Za-z0-9_-])|\G)[A-Za-z0-9_-]{28}", None),
    (r"(?=[A-Z])" + EXACT[9], None),
    (r"(?=\d)" + EXACT[10], None),
)
NAME = 9
#: What the exact forms of their tokens look like.
FORMS = (r"[a-z]{2,}", r".*@.*", r"[\d/.-]+", r"[\d/]+", r"\d{4}", r"(?:npr)?[\s\d.]*", r"(?:rs\.?)?[\s\d.]*", r"\$?[\d.]*", r"[a-z0-9_-]{28}", r"[a-z]+(?:\s[a-z]+)*", r"[\d.\s-]+")
UNIT_WORDS = ("lakh", "crore", "thousand", "million")
UNIT = r"(?i)(?:NPR|Rs\.?|\$|USD|AED)\s*\d+(?:\.\d+)?\s*(lakh|crore|thousand|million)"


def entity_tokens(c: Column, terms: list[str] | None = None) -> Column:
    """Acronyms, addresses, dates, amounts, ids, names and phone numbers, each also in lower case.

    terms: words without blanks; then all tokens that are one of them, or whose exact form is, and some others.
    """

    def every(pattern: str, group: int, *signs: Column) -> Column:
        all_ = F.regexp_extract_all(c, F.lit(pattern), F.lit(group))
        return F.when(reduce(lambda a, b: a | b, signs), all_).otherwise(F.array().cast("array<string>")) if signs else all_

    wanted = lambda form: terms is None or any(re.fullmatch(form, t) for t in terms)
    low = lambda *words: [F.contains(F.lower(c), F.lit(w)) for w in words]
    parts = []
    for k, ((pattern, sign), form) in enumerate(zip(QUICK, FORMS, strict=True)):
        if wanted(form):
            # a name becomes one word only where its first word is taken for a currency
            named = k == NAME and terms is not None
            parts.append(every(pattern, 0, *([F.contains(c, F.lit(w)) for w in ("Npr ", "Rs ", "Usd ")] if named else low(sign) if sign else [])))
    if wanted("|".join(UNIT_WORDS)):
        parts.append(every(UNIT, 1, *low(*UNIT_WORDS)))
    found = F.flatten(F.array(*parts)) if parts else F.array().cast("array<string>")
    # named once: Spark would find all of it again for each place where it stands
    both = F.transform(F.array(found), lambda f: F.array_distinct(F.concat(f, F.transform(f, F.lower))))
    return F.when(c.isNotNull(), F.try_element_at(both, F.lit(1)))


def exact_form(c: Column) -> Column:
    """Lower case without commas and currency prefixes."""
    # each prefix goes once at most, in this order
    return F.trim(F.regexp_replace(F.replace(F.lower(c), F.lit(","), F.lit("")), r"\A(?:npr )?(?:rs )?(?:rs\. )?\$?(?:usd )?", ""))


def short_hash(c: Column, prefix: str = "", digits: int = 16) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(c.cast("binary"), 256), 1, digits))


def char_grams(c: Column, size: int = 4) -> Column:
    """Distinct runs of `size` characters of the lower-case text; a shorter text is one gram."""
    low = F.lower(c)
    # a look-ahead finds overlapping runs in one pass; none starts within a surrogate pair
    many = F.array_distinct(F.regexp_extract_all(low, F.lit(rf"(?s)(?=(\P{{Cs}}.{{{size - 1}}}))"), F.lit(1)))
    return F.when(F.char_length(low) < size, F.array(low)).otherwise(many)
