"""Text folding. Normalisation forms and case folding need Python, so these are Arrow-batched and used once a row."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from concordia.plans.policy import LEGAL_FORMS, MANUFACTURER_ALIASES, TOKEN_ALIASES

# Zero-width space, non-joiner and joiner, byte-order mark, soft hyphen, word joiner.
_INVISIBLE = dict.fromkeys((0x200B, 0x200C, 0x200D, 0xFEFF, 0x00AD, 0x2060))
# What separates the words of a company's name.
_SEPARATORS = re.compile(r"[.,()/&+\-‐-―−]+")
_EDITION = r"\s*:\s*(\d{4})\s*$"


def _fold(s: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", s).casefold().split())


def _each(f):
    """A pandas UDF of f over strings; null stays null, and equal strings of a batch are folded once."""

    @F.pandas_udf(StringType())
    def udf(s: pd.Series) -> pd.Series:
        known = {x: f(x) for x in s.dropna().unique()}
        return pd.Series([known.get(x) for x in s], dtype=object)

    return udf


def fold(c: Column) -> Column:
    """NFKC, case folding, white space collapsed."""
    return _each(_fold)(c)


def _token(s: str) -> str | None:
    s = unicodedata.normalize("NFKC", s).translate(_INVISIBLE).casefold()
    words = re.sub(r"[-_]", " ", re.sub(r"\s*/\s*", "/", s)).split()
    s = "_".join(words)
    return TOKEN_ALIASES.get(s, s) or None


def token(c: Column) -> Column:
    """A vocabulary token as it is compared: folded, invisible characters gone, separators one underscore, aliases resolved."""
    return _each(_token)(c)


def _manufacturer(s: str) -> str | None:
    s = unicodedata.normalize("NFKD", s).casefold()
    words = _SEPARATORS.sub(" ", "".join(c for c in s if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")).split()
    n = len(words)
    while n and words[n - 1] in LEGAL_FORMS:
        n -= 1
    key = " ".join(words[:n])
    return MANUFACTURER_ALIASES.get(key, key) or None


def manufacturer_key(c: Column) -> Column:
    """Company name without trailing legal forms, folded, aliases resolved; null where nothing is left."""
    return _each(_manufacturer)(c)


def manufacturer_key_ascii(c: Column) -> Column:
    """manufacturer_key() in SQL functions alone, for names known to be ASCII."""
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), r"[.,()/&+\-\s]+", " ")))
    key = F.trim(F.regexp_replace(words, f"( ({'|'.join(LEGAL_FORMS)}))+$", ""))
    out = key
    for a, b in MANUFACTURER_ALIASES.items():
        out = F.when(key == a, b).otherwise(out)
    return F.nullif(out, F.lit(""))


def model_text(c: Column) -> Column:
    """A model string as tokens are read from it: NFKD, case folding, anything else than letters, digits, + and * a space."""
    return _each(lambda s: re.sub(r"[^0-9a-z+*]+", " ", unicodedata.normalize("NFKD", s).casefold()))(c)


@F.pandas_udf(StringType())
def python_repr(x: pd.Series) -> pd.Series:
    """Shortest text of a double that reads back as it (1e7 is 10000000.0); None for null."""
    return pd.Series(["None" if pd.isna(v) else repr(float(v)) for v in x], dtype=object)


def collapse(c: Column) -> Column:
    """White space collapsed and ends trimmed, in SQL functions; lower-cased, for ASCII text."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def edition(c: Column) -> tuple[Column, Column]:
    """(text without a trailing ``: YYYY``, the year or null)."""
    return F.regexp_replace(c, _EDITION, ""), F.nullif(F.regexp_extract(c, _EDITION, 1), F.lit(""))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of a text padded by two spaces before and one after, separators folded to one space."""
    t = F.concat(F.lit("  "), F.trim(F.regexp_replace(F.lower(c), "[^0-9a-z]+", " ")), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.substring(t, i, F.lit(3))))


def tokens(c: Column) -> Column:
    """Distinct lower-case words of letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[0-9a-z]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
