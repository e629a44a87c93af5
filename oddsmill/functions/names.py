"""Name keys. Only the Unicode decomposition runs in Python (Arrow batches); the rest is column work."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import constants as K
from .exprs import c, lookup


NON_ASCII = re.compile(r"[^\x00-\x7f]+")


@lru_cache(maxsize=1 << 16)
def _fold_run(run: str) -> str:
    """Decompose a run of non-ASCII characters and drop its combining marks. Runs repeat a lot, so most are cached."""
    return "".join(ch for ch in unicodedata.normalize("NFKD", run) if not unicodedata.combining(ch))


@F.pandas_udf(StringType())
def _strip_marks(s: pd.Series) -> pd.Series:
    def fold(text):
        if text is None or text.isascii():   # ASCII is untouched by decomposition
            return text
        return NON_ASCII.sub(lambda m: _fold_run(m.group()), text)

    return s.map(fold)


def fold_marks(x) -> Column:
    """Drop diacritics. Pure-ASCII values never reach Python's normaliser with any change."""
    return _strip_marks(c(x))


def canonical_name(x, folded: bool = False) -> Column:
    """Folded, punctuation to space, lower, single spaces, trailing suffixes removed, overrides applied."""
    text = c(x) if folded else fold_marks(x)
    words = F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, r"[^a-zA-Z0-9\s]", " ")), r"\s+", " "))
    bare = F.regexp_replace(words, r"(^|\s)(" + "|".join(K.NAME_SUFFIXES) + r")(\s(" + "|".join(K.NAME_SUFFIXES) + r"))*$", "")
    return F.coalesce(lookup(K.NAME_OVERRIDES, bare), bare)


def name_key(x, folded: bool = False) -> Column:
    """Compact key used for joins; null when nothing is left."""
    return F.nullif(F.regexp_replace(canonical_name(x, folded), "[^a-z0-9]", ""), F.lit(""))
