"""Text as column expressions; Arrow-batched functions only for what the JVM lacks (entities, NFKC, stems)."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrow import arrow_function
from .stemmer import stem


def squeeze(s: Column) -> Column:
    """Runs of white space (no-break spaces included) as one space, none at the ends."""
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def strip(s: Column) -> Column:
    """White space of any kind off the ends."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def query_words(q: Column) -> Column:
    """Words of a query between white space, lower case; repeated words stay."""
    return F.filter(F.split(F.lower(q), r"(?U)\s+"), lambda w: w != "")


def tokens(s: Column) -> Column:
    """Runs of letters and numbers, lower case."""
    return F.filter(F.split(F.lower(s), r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: w != "")


def index_tokens(s: Column, most_bytes: int = 40) -> Column:
    """Tokens of titles and urls in the index: those of ``most_bytes`` bytes or more are left out."""
    return F.filter(tokens(s), lambda w: F.octet_length(w) < most_bytes)


def html_escape(s: Column) -> Column:
    """``& < > "`` as entities."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def or_empty(s: Column) -> Column:
    return F.coalesce(s, F.lit(""))


def http_only(s: Column) -> Column:
    """An image source if it is an http(s) url, else null."""
    return F.when(F.startswith(s, F.lit("http")), s)


def plain_ampersands(s: Column) -> Column:
    return F.replace(s, F.lit("&amp;"), F.lit("&"))


def seconds(ms: Column) -> Column:
    """Whole seconds of a text of milliseconds; 0 if missing or no number."""
    n = ms.try_cast("bigint")
    return F.coalesce(F.when(n >= 0, F.floor(n / 1000).cast("bigint")), F.lit(0))


def source_class(source: Column) -> Column:
    """Style class of a source's name."""
    return F.replace(source, F.lit(" "), F.lit("-"))


def fill(template: str, **values: Column) -> Column:
    """A template with its ``{{NAME}}`` marks replaced in the order given."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), value)
    return out


def _each(fn):
    return lambda s: pd.Series([None if x is None else fn(x) for x in s], dtype=object)


@arrow_function("string")
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition. Plain ASCII passes as it is."""
    return _each(lambda x: x if x.isascii() else unicodedata.normalize("NFKC", x))(s)


@arrow_function("string")
def _unescape(s: pd.Series) -> pd.Series:
    return _each(html.unescape)(s)


def unescape(s: Column) -> Column:
    """Entities decoded once; texts without ``&`` never leave the JVM."""
    return F.when(F.contains(s, F.lit("&")), _unescape(s)).otherwise(s)


def strip_html(s: Column) -> Column:
    """The text of markup: tags out, entities decoded, white space squeezed. Scripts and comments are dropped."""
    bare = F.regexp_replace(s, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "")
    return squeeze(unescape(F.regexp_replace(bare, r"(?s)</?[A-Za-z!?][^>]*>", "")))


@arrow_function("array<string>")
def stems(words: pd.Series) -> pd.Series:
    """English stems of arrays of lower-case words."""
    cache: dict[str, str] = {}

    def one(w: str) -> str:
        got = cache.get(w)
        if got is None:
            got = cache[w] = stem(w)
        return got

    return pd.Series([None if ws is None else [one(w) for w in ws] for ws in words], dtype=object)
