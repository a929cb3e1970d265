"""Small text rules used across the corpus operators, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word characters are letters, numbers and underscore in any script.
TOKEN_PATTERN = r"(?U)([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+)"
SPAN_DELIMITER = ", "
# All white space of Unicode.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def strip_simple(text: Column) -> Column:
    """As :func:`strip`, for a column or a lambda's variable; a longer expression would be computed several times.

    Spaces go first. Only a text that then begins or ends with a control or non-ASCII character is looked at with the whole set, which is much dearer.
    """
    inner = F.trim(text)
    odd = lambda c: ~F.ascii(c).between(33, 126)
    return F.when(odd(inner) | odd(F.right(inner, F.lit(1))), F.btrim(inner, F.lit(WHITE_SPACE))).otherwise(inner)


def tokens(text: Column) -> Column:
    """Lower-cased runs of word characters and runs of other non-space characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(1))


def token_count(text: Column) -> Column:
    """Number of tokens, a model-free stand-in for the encoded length of a text."""
    return F.regexp_count(text, F.lit(TOKEN_PATTERN))


def strip_quotes(text: Column) -> Column:
    """Remove one pair of equal quotes around a text; a lone quote becomes empty text."""
    first, last = F.left(text, F.lit(1)), F.right(text, F.lit(1))
    quoted = (first == last) & first.isin("'", '"')
    return F.when(quoted, F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)


def unescape_field(text: Column) -> Column:
    r"""Undo ``\n``, ``\p`` (a bar) and ``\\``, in this order."""
    text = F.replace(text, F.lit("\\n"), F.lit("\n"))
    text = F.replace(text, F.lit("\\p"), F.lit("|"))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def unescape_list(text: Column) -> Column:
    """A bar-joined field as a list of unescaped items."""
    return F.transform(F.split(text, r"\|", -1), unescape_field)


def question_key(text: Column) -> Column:
    """A table name derived from the text itself: ``f`` and its MD5."""
    return F.concat(F.lit("f"), F.md5(text))


def clean_query_text(query: Column) -> Column:
    r"""Settle the query shorthand: ``not null``, ``present_ref``, `` * `` and escaped quotes."""
    # The shorthand and what it stands for, applied in this order.
    for old, new in [("not null", "is not null"), ("present_ref", "2014"), (" * ", " id "), ("\\'", " ")]:
        query = F.replace(query, F.lit(old), F.lit(new))
    return query


def clean_cell_text(cell: Column, query: Column) -> Column:
    """Cells lose single quotes (to a space) when the query held an escaped one."""
    return F.when(F.contains(query, F.lit("\\'")), F.replace(cell, F.lit("'"), F.lit(" "))).otherwise(cell)
