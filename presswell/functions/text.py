"""Text keys as JVM expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANKS = "[\\s\\p{Z}\\u200b\\ufeff]"


def casefold(c: Column) -> Column:
    """Case folding without a Python worker: small letters, the sharp s as the two letters that its capital form has."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def strip(c: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(c, f"^{BLANKS}+|{BLANKS}+$", "")


def collapse_blanks(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{BLANKS}+", " "))


def letters_and_digits(c: Column) -> Column:
    """The letters and digits of c, case folded: what decides whether two titles are the same."""
    return F.regexp_replace(casefold(c), "[^\\p{L}\\p{N}]+", "")


def letters_only(c: Column) -> Column:
    """The letters of c, case folded: what decides whether two lines are the same."""
    return F.regexp_replace(casefold(c), "[^\\p{L}]+", "")


def normalised(c: Column) -> Column:
    """Compatibility-normalised, case-folded text with plain quotes and dashes and single blanks.

    The exact form needs Unicode tables that only Python has; texts of plain letters take the JVM path.
    """
    simple = F.trim(F.regexp_replace(F.lower(c), "\\s+", " "))
    return F.when(c.rlike("^\\p{ASCII}*$"), simple).otherwise(_normalised(c))


def normalise(text: str | None) -> str:
    folded = unicodedata.normalize("NFKC", text or "").casefold()
    return " ".join(folded.translate({0x2019: "'", 0x2013: "-", 0x2014: "-"}).split())


@F.pandas_udf(T.StringType())
def _normalised(texts: pd.Series) -> pd.Series:
    return texts.map(normalise, na_action="ignore")


#: Words that no query and no document is ranked by.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "das", "de", "der", "des", "die", "en", "et", "for", "from", "für", "in", "is", "la", "le", "les", "of", "on", "or", "the", "to", "und", "von", "with", "zu")
TOKEN = "(?U)[^\\W_]+(?:-[^\\W_]+)*"


def tokens(normal: Column) -> Column:
    """The words of a normalised text, hyphenated ones whole, stop words left out, repetitions kept."""
    return F.filter(F.regexp_extract_all(normal, F.lit(TOKEN), F.lit(0)), lambda w: ~w.isin(*STOP_WORDS))


def date_text(c: Column) -> Column:
    """The first date-like stretch of a text, by the kind of notation and not by its place."""
    kinds = (
        r"\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?(?:Z|[+-]\d{2}:?\d{2})?)?",
        r"\d{1,2}[./]\d{1,2}[./]\d{4}",
        r"\d{1,2}\.?\s+\p{L}+\.?\s+\d{4}",
        r"\p{L}+\s+\d{1,2},?\s+\d{4}",
    )
    return F.coalesce(*[F.nullif(F.regexp_extract(c, k, 0), F.lit("")) for k in kinds], F.lit(""))


def precision(raw: Column) -> Column:
    """datetime for a value with a clock time, else date."""
    return F.when(raw.rlike(r"\d{1,2}:\d{2}|T\d{2}"), "datetime").otherwise("date")


def safe_cell(c: Column) -> Column:
    """Text that a spreadsheet takes for text: no control characters, and a quote before what looks like a formula."""
    clean = F.regexp_replace(c, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")
    return F.when(clean.rlike("^[=+\\-@]"), F.concat(F.lit("'"), clean)).otherwise(clean)


def shortened(c: Column, limit: int = 500) -> Column:
    """At most `limit` characters, the last an ellipsis where something was cut."""
    return F.when(F.length(c) > limit, F.concat(F.rtrim(F.substring(c, 1, limit - 1)), F.lit("…"))).otherwise(c)


def guid(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.trim(c), "[{}-]", ""))


def redacted_url(url: Column) -> Column:
    """url without credentials and fragment, and with the values of secret parameters hidden."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@", "$1")
    return F.regexp_replace(bare, "(?i)([?&](?:[^=&]*(?:token|key|secret|password|passwd|auth|signature|session)[^=&]*)=)[^&]*", "$1[redacted]")
