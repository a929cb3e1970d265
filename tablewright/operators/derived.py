"""Columns derived from list-like text: pieces, years, numbers, months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.text import strip_simple
from tablewright.functions.numbers import to_float

# English month names in calendar order.
MONTHS = "january february march april may june july august september october november december".split()
YEAR_PATTERN = r"\b\d{4}\b"


def address_parts(text: Column) -> Column:
    return F.split(text, ", ", -1)


def choose_delimiter(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``(keys, delimiter)``: comma, dash or newline, whichever cuts the column in most pieces.

    Ties go to the earlier of the three. Only counts are shuffled.
    """

    def pieces(mark: str) -> Column:
        return F.coalesce(F.sum(F.length(text) - F.length(F.replace(F.col(text), F.lit(mark), F.lit("")))), F.lit(0))

    counts = df.groupBy(*keys).agg(pieces(",").alias("commas"), pieces("-").alias("dashes"), pieces("\n").alias("lines"))
    delimiter = (
        F.when((F.col("commas") >= F.col("dashes")) & (F.col("commas") >= F.col("lines")), F.lit(","))
        .when(F.col("dashes") >= F.col("lines"), F.lit("-"))
        .otherwise(F.lit("\n"))
    )
    return counts.select(*keys, delimiter.alias("delimiter"))


def pieces(text: Column, delimiter: Column) -> Column:
    """Trimmed pieces between delimiters."""
    return F.transform(F.split(text, delimiter, -1), strip_simple)


def list_items(text: Column, delimiter: Column) -> Column:
    """Pieces, cut again at ``/``, without empty ones; missing text is an empty list."""
    cut = F.flatten(F.transform(pieces(text, delimiter), lambda p: F.split(p, "/", -1)))
    return F.coalesce(F.filter(cut, lambda p: p != ""), F.array().cast("array<string>"))


def greatest_piece(text: Column, delimiter: Column) -> Column:
    """The last piece in text order."""
    return F.array_max(pieces(text, delimiter))


def least_piece(text: Column, delimiter: Column) -> Column:
    """The first piece in text order."""
    return F.array_min(pieces(text, delimiter))


def first_number(text: Column) -> Column:
    return to_float(F.regexp_extract(text, r"(\d+\.\d+|\d+)", 1))


def first_year(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, YEAR_PATTERN, 0), F.lit(""))


def _per_range(text: Column, single, pick) -> Column:
    """For each ``, `` piece: ``single`` of a plain piece, ``pick`` of the parts of an ``a-b`` range.

    Missing text gives one missing entry.
    """

    def one(piece: Column) -> Column:
        return F.when(F.contains(piece, F.lit("-")), pick(F.split(piece, "-", -1))).otherwise(single(piece))

    return F.coalesce(F.transform(F.split(text, ", ", -1), one), F.array(F.lit(None).cast("string")))


def _years(parts: Column) -> Column:
    return F.transform(parts, lambda p: first_year(p).try_cast("int"))


def _integers(parts: Column) -> Column:
    return F.transform(parts, lambda p: strip_simple(p).try_cast("bigint"))


def latest_years(text: Column) -> Column:
    return _per_range(text, first_year, lambda parts: F.array_max(_years(parts)).cast("string"))


def earliest_years(text: Column) -> Column:
    return _per_range(text, first_year, lambda parts: F.array_min(_years(parts)).cast("string"))


def range_minimums(text: Column) -> Column:
    return _per_range(text, lambda p: p, lambda parts: F.array_min(_integers(parts)).cast("string"))


def range_maximums(text: Column) -> Column:
    return _per_range(text, lambda p: p, lambda parts: F.array_max(_integers(parts)).cast("string"))


def names_before_brackets(text: Column) -> Column:
    """Runs of words, each with its bracketed remark dropped, trimmed."""
    runs = F.regexp_extract_all(text, F.lit(r"(?U)([\w\s°]+)(?:\s*\([^)]*\))?"), F.lit(1))
    return F.transform(runs, lambda r: F.regexp_replace(r, r"(?U)^\s+|\s+$", ""))


def month_number(text: Column) -> Column:
    """``'1'`` to ``'12'`` when the first word is a full English month name, else NULL."""
    word = F.lower(F.regexp_extract(text, "([a-zA-Z]+)", 1))
    position = F.array_position(F.array(*map(F.lit, MONTHS)), word)
    return F.when(position > 0, position.cast("string"))
