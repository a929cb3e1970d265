"""Numbers written as text: parsing, strict checks and printing, as Column expressions.

Text is read with the grammar of Python's ``int()`` and ``float()``: Spark's own cast
would also take ``1d`` and would refuse ``1_000``, so a pattern guards every cast.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The number grammar. A float is digits with optional point and exponent, or a named value.
INT_PATTERN = r"^\s*[+-]?\d+(_\d+)*\s*$"
# What a repetition has taken it keeps: none could match with less.
FLOAT_PATTERN = (
    r"^\s*+([+-]?+(?:(?:\d++(?:_\d++)*+\.?+(?:\d++(?:_\d++)*+)?+|\.\d++(?:_\d++)*+)(?:[eE][+-]?+\d++(?:_\d++)*+)?+"
    r"|(?i:nan|inf|infinity)))\s*+$"
)
DECIMAL_COMMA_PATTERN = r"^(?![^,]{3},)([^,.]*),(?![^,]{3}$)([^,.]*)$"
SEVERAL_DOTS_PATTERN = r"^[^,.]*\.[^,.]*\.[^,]*$"
BOOLEAN_WORDS = ["true", "false", "1", "0", "nan", "none"]


def is_int_text(text: Column) -> Column:
    """True where ``int(text)`` would succeed."""
    return text.rlike(INT_PATTERN)


def to_float(text: Column) -> Column:
    """``float(text)``, or NULL where that fails (missing text included)."""
    # The number found, or NULL: a cast of text that is no number costs as much as an exception does.
    found = F.get(F.regexp_extract_all(text, F.lit(FLOAT_PATTERN), F.lit(1)), F.lit(0))
    return F.replace(found, F.lit("_"), F.lit("")).try_cast("double")


def float_or_null(text: Column) -> Column:
    """``float(text)`` where the result is a usable number: NaN counts as missing."""
    value = to_float(text)
    return F.when(~F.isnan(value), value)


def to_floats(texts: Column) -> Column:
    """``float_or_null`` over a list column, one entry per input entry."""
    return F.transform(texts, float_or_null)


def loose_float(text: Column) -> Column:
    """Read a number that may carry thousands separators or a decimal comma.

    The first rule that applies decides: both ``.`` and ``,`` present (commas separate
    thousands); a comma-separated piece of three characters (thousands); a single comma
    (decimal point); several dots; several commas; otherwise a plain number.
    """
    decimal_comma = F.regexp_replace(text, DECIMAL_COMMA_PATTERN, "$1.$2")
    cleaned = F.when(text.rlike(SEVERAL_DOTS_PATTERN), F.replace(text, F.lit("."), F.lit(""))).otherwise(
        F.replace(decimal_comma, F.lit(","), F.lit(""))
    )
    return to_float(cleaned)


def float_text(number: Column) -> Column:
    """Print a double as Python's ``str(float)`` does: ``5.0``, ``12345678.25``, ``1e+16``.

    ``number`` appears several times in the result, so pass a column rather than a long expression.
    """
    shortest = number.cast("string")
    # Spark switches to scientific notation at 1e7 and below 1e-3, Python at 1e16 and below 1e-4.
    positional = F.regexp_replace(number.try_cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")
    signed = F.regexp_replace(shortest, r"(\.0)?E(?=\d)", "e+")
    scientific = F.regexp_replace(F.regexp_replace(signed, r"(\.0)?E-", "e-"), r"e([+-])(\d)$", "e$10$2")
    return (
        F.when(~F.contains(shortest, F.lit("E")), F.lower(F.replace(shortest, F.lit("Infinity"), F.lit("inf"))))
        .when(F.abs(number).between(1e-4, 9.999999999999998e15), positional)
        .otherwise(scientific)
    )


def int_text(text: Column) -> Column:
    """The canonical print of an integer text: no plus sign, padding, underscore or leading zero."""
    digits = F.regexp_replace(text, r"[\s_]", "")
    unsigned = F.regexp_replace(digits, r"^[+-]?0*(?=\d)", "")
    return F.when(digits.startswith("-") & (unsigned != "0"), F.concat(F.lit("-"), unsigned)).otherwise(unsigned)


def value_kind(text: Column, is_int: Column | None = None, number: Column | None = None) -> Column:
    """``int``, ``float`` or ``text``, whichever of Python's conversions succeeds first.

    Columns that already hold ``is_int_text`` and ``to_float`` of the text may be given.
    """
    is_int, number = is_int_text(text) if is_int is None else is_int, to_float(text) if number is None else number
    return F.when(is_int, F.lit("int")).when(number.isNotNull(), F.lit("float")).otherwise(F.lit("text"))


def value_text(text: Column, is_int: Column | None = None, number: Column | None = None) -> Column:
    """The print of the typed value: ``007`` gives ``7``, ``1e3`` gives ``1000.0``, other text is kept. As :func:`value_kind`."""
    is_int, number = is_int_text(text) if is_int is None else is_int, to_float(text) if number is None else number
    return F.when(is_int, int_text(text)).when(number.isNotNull(), float_text(number)).otherwise(text)


def is_strict_int(text: Column) -> Column:
    """An integer without leading zeros; ``0`` itself is allowed."""
    return F.coalesce((text == "0") | (~text.rlike(r"^-?0") & is_int_text(text)), F.lit(False))


def is_strict_float(text: Column) -> Column:
    """A number without leading zeros: ``0.5`` and ``-0.5`` pass, ``00.5``, ``01`` and ``-01`` do not."""
    leading_zero = text.rlike(r"^0\d") | text.rlike(r"^-0(?!\.)")
    return F.coalesce(text.isin("0", "0.0") | (~leading_zero & to_float(text).isNotNull()), F.lit(False))


def is_bool_text(text: Column) -> Column:
    """True for the words that read as a truth value or as missing."""
    return F.coalesce(F.lower(text).isin(BOOLEAN_WORDS), F.lit(False))


def julian_day(text: Column) -> Column:
    """Julian day number of a ``yyyy-MM-dd`` text; NULL when it is not a date."""
    is_shape = text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$")
    date = F.when(is_shape, F.try_to_date(text, "yyyy-M-d"))
    return F.datediff(date, F.lit("1970-01-01").cast("date")) + F.lit(2440587.5)


def exact_sum(number: Column) -> Column:
    """Sum of doubles that does not depend on row order.

    Values with at most six decimals are added as decimals and give the correctly rounded
    sum; a group holding any other value is added as doubles.
    """
    decimal = number.try_cast("decimal(28,6)")
    representable = F.bool_and(F.coalesce(decimal.cast("double") == number, number.isNull()))
    return F.when(representable, F.sum(decimal).cast("double")).otherwise(F.sum(number))
