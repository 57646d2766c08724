"""Text functions over columns: strip, fold, normalise, analysers. Built-in expressions wherever they say it exactly."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from evidence.functions.stemmer import STOP_WORDS, stem

_SPACE = r"[\s\x1c-\x1f]"
_EDGE = rf"(?U)^{_SPACE}+|{_SPACE}+$"
# Fixed value: punctuation that doesn't count at the ends of a question.
EDGE = " \t\r\n.,!?;:\"'`()[]…-"
TOKEN = r"[\p{L}\p{N}]+"


def strip(c: Column) -> Column:
    """Without white space at either end, as Unicode has it; trim() knows the space only."""
    return F.regexp_replace(c, _EDGE, "")


def blank_to_null(c: Column) -> Column:
    """The stripped text, null if nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def normalise(c: Column) -> Column:
    """Control characters dropped, runs of white space one space, stripped. Null is empty."""
    plain = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return strip(F.regexp_replace(plain, r"(?U)\s+", " "))


def fold_text(text: str) -> str:
    low = unicodedata.normalize("NFD", text.lower())
    return "".join(ch for ch in low if not unicodedata.combining(ch)).replace("đ", "d")


def fold(c: Column) -> Column:
    """Lower case without diacritics; no built-in collation folds just these."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(fold_text, na_action="ignore")

    return F.pandas_udf(run, "string")(c)


def bare(c: Column) -> Column:
    """Without punctuation at the ends, with single spaces."""
    return F.regexp_replace(strip(F.btrim(c, F.lit(EDGE))), r"(?U)\s+", " ")


def tokens(c: Column) -> Column:
    """The simple analyser: lower-case runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


_WORD = re.compile(r"[^\W_]+")


def english_tokens(text: str | None) -> list[str]:
    return [stem(w) for w in _WORD.findall((text or "").lower()) if w not in STOP_WORDS]


def english(c: Column) -> Column:
    """The English analyser: stop words dropped, words stemmed."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(english_tokens)

    return F.pandas_udf(run, "array<string>")(c)


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)
