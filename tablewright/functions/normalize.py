"""The two text rules Spark has no expression for, as Arrow-batched functions usable in SQL too."""

from __future__ import annotations

import re
import sys
import unicodedata

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors need not have this package installed: its functions travel with the query.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Characters read as a plain quote or dash, and the remarks dropped from the end of a text.
QUOTES = {"‘": "'", "’": "'", "´": "'", "`": "'", "“": '"', "”": '"'}
DASHES = {dash: "-" for dash in "‐‑‒–—−"}
PLAIN_MARKS = str.maketrans({**QUOTES, **DASHES})
CITATIONS_AT_END = re.compile(r"((?<!^)\[[^\]]*\]|\[\d+\]|[•♦†‡*#+])*$")
BRACKETS_AT_END = re.compile(r"(?<!^)( \([^)]*\))*$")
WHOLLY_QUOTED = re.compile(r'^"([^"]*)"$')
SPACES = re.compile(r"\s+")


def without_remarks(text: str) -> str:
    """Cut citations and bracketed remarks from the end for as long as there are any."""
    longer, text = None, text.strip()
    while text != longer:
        longer, text = text, BRACKETS_AT_END.sub("", CITATIONS_AT_END.sub("", text).strip()).strip()
    return text


def normalized(text: str | None) -> str | None:
    """Lower case, without accents, trailing citations, bracketed remarks, outer quotes and final dot."""
    if text is None:
        return None
    if not text.isascii():
        decomposed = unicodedata.normalize("NFKD", text)
        text = "".join(c for c in decomposed if unicodedata.category(c) != "Mn")
    text = without_remarks(text.translate(PLAIN_MARKS))
    # Quotes hold no quotes, so they come off once at most; what they held may end in remarks of its own.
    if quoted := WHOLLY_QUOTED.match(text):
        text = without_remarks(quoted[1])
    return SPACES.sub(" ", text.removesuffix(".")).lower().strip()


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit per character of ``a``."""
    places: dict[str, int] = {}
    for i, char in enumerate(a):
        places[char] = places.get(char, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for char in b:
        matched = row & places.get(char, 0)
        row = (row + matched | row - matched) & full
    return len(a) - row.bit_count()


def similarity(a: str | None, b: str | None) -> int:
    """0 to 100: the share of both texts in their longest common subsequence. Empty or missing text gives 0."""
    if a is None or b is None:
        return 0
    if a == b:
        return 100
    if not a or not b:
        return 0
    return round(200 * common_length(a, b) / (len(a) + len(b)))


@F.pandas_udf(T.StringType())
def normalize_text(texts: pd.Series) -> pd.Series:
    return texts.map(normalized)


@F.pandas_udf(T.ArrayType(T.StringType()))
def normalize_texts(lists: pd.Series) -> pd.Series:
    return lists.map(lambda texts: None if texts is None else [normalized(t) for t in texts])


@F.pandas_udf(T.IntegerType())
def fuzz_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([similarity(a, b) for a, b in zip(left, right)], dtype="int32")


def register(spark: SparkSession) -> None:
    """Make ``normalize_text`` and ``fuzz_ratio`` callable from SQL."""
    spark.udf.register("normalize_text", normalize_text)
    spark.udf.register("fuzz_ratio", fuzz_ratio)
