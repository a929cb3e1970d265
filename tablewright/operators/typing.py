"""Types found in text: per column by vote, per result by its form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.binding import let
from tablewright.functions.numbers import float_text, is_int_text, is_strict_float, is_strict_int, to_float, value_kind
from tablewright.functions.numbers import value_text as typed_text
from tablewright.functions.text import strip, strip_simple
from tablewright.skew import in_order

# Date forms by the shape of the text: only a text of the right shape reaches a parser, and only shapes of its class are tried.
_DAY, _CLOCK = r"^\d{4}-\d{1,2}-\d{1,2}", r"[ T]\d{1,2}:\d{2}"
DASHED = {
    rf"{_DAY}$": "yyyy-M-d",
    rf"{_DAY}{_CLOCK}$": "yyyy-M-d H:mm",
    rf"{_DAY}{_CLOCK}:\d{{2}}(?:\.\d{{1,6}})?$": "yyyy-M-d H:mm:ss[.SSSSSS]",
    rf"{_DAY}{_CLOCK}:\d{{2}}(?:\.\d{{1,6}})?(?:Z|[+-]\d{{2}}:\d{{2}})$": "yyyy-M-d H:mm:ss[.SSSSSS]XXX",
}
YEAR_FIRST = {r"^\d{4}/\d{1,2}/\d{1,2}$": "yyyy/M/d"}
MONTH_FIRST = {r"^\d{1,2}/\d{1,2}/\d{4}$": "M/d/yyyy"}
DAY_FIRST = {r"^\d{1,2} [A-Za-z]{3} \d{4}$": "d MMM yyyy", r"^\d{1,2} [A-Za-z]{4,} \d{4}$": "d MMMM yyyy"}
NAMED_DAY = {r"^[A-Za-z]{3} \d{1,2}, \d{4}$": "MMM d, yyyy", r"^[A-Za-z]{4,} \d{1,2}, \d{4}$": "MMMM d, yyyy"}
NAMED_MONTH = {r"^[A-Za-z]{3} \d{4}$": "MMM yyyy", r"^[A-Za-z]{4,} \d{4}$": "MMMM yyyy"}
# Every form has between 8 and 40 characters.
SHORTEST_DATE, LONGEST_DATE = 8, 40
RESULT_MARK = r"\| "
LIST_MARK = ",, "


def to_timestamp(text: Column) -> Column:
    """A timestamp in one of the known forms, else NULL. A month and year alone mean its first day."""

    def in_form(stripped: Column, forms: dict[str, str]) -> Column:
        parsed = F.lit(None).cast("timestamp")
        for shape, form in reversed(forms.items()):
            spaced = F.replace(stripped, F.lit("T"), F.lit(" ")) if "[ T]" in shape else stripped
            parsed = F.when(stripped.rlike(shape), F.try_to_timestamp(spaced, F.lit(form))).otherwise(parsed)
        return parsed

    def judged(stripped: Column) -> Column:
        fifth, digit = F.substring(stripped, 5, 1), F.ascii(stripped).between(ord("0"), ord("9"))
        holds = lambda mark: F.contains(stripped, F.lit(mark))
        return (
            F.when(~F.length(stripped).between(SHORTEST_DATE, LONGEST_DATE), F.lit(None).cast("timestamp"))
            .when(digit & (fifth == "-"), in_form(stripped, DASHED))
            .when(digit & (fifth == "/"), in_form(stripped, YEAR_FIRST))
            .when(digit & holds("/"), in_form(stripped, MONTH_FIRST))
            .when(digit & holds(" "), in_form(stripped, DAY_FIRST))
            .when(~digit & holds(", "), in_form(stripped, NAMED_DAY))
            .when(~digit & holds(" "), in_form(stripped, NAMED_MONTH))
        )

    # Every form holds one of these marks inside; most cells do not and need no closer look.
    marked = F.contains(text, F.lit("-")) | F.contains(text, F.lit("/")) | F.contains(text, F.lit(" "))
    return F.when((F.length(text) >= SHORTEST_DATE) & marked, let(strip_simple(text), judged))


def identify_cells(raw_cells: DataFrame) -> DataFrame:
    """Type every cell on its own: adds ``kind`` (int, float or text), ``num`` and the printed ``value``."""
    raw, is_int, number = F.col("raw"), F.col("_int"), F.col("_num")
    read = raw_cells.withColumns({"_int": is_int_text(raw), "_num": to_float(raw)})
    typed = {"kind": value_kind(raw, is_int, number), "num": number, "value": typed_text(raw, is_int, number)}
    return read.withColumns(typed).drop("_int", "_num")


def vote_column_types(cells: DataFrame) -> DataFrame:
    """``(table_id, col_pos, n_cells, n_numbers, n_dates, kind)`` from cells with ``raw`` text.

    A column with any number is ``number``, else with any date ``timestamp``, else ``text``.
    """
    number = to_float(F.col("raw"))
    tested = cells.select("table_id", "col_pos", number.alias("num"), to_timestamp(F.col("raw")).alias("at"))
    counted = tested.groupBy("table_id", "col_pos").agg(
        F.count("*").alias("n_cells"),
        F.count_if(F.col("num").isNotNull() & ~F.isnan("num")).alias("n_numbers"),
        F.count("at").alias("n_dates"),
    )
    kind = F.when(F.col("n_numbers") > 0, F.lit("number")).when(F.col("n_dates") > 0, F.lit("timestamp"))
    return counted.withColumn("kind", kind.otherwise(F.lit("text")))


def apply_column_types(raw_rows: DataFrame, votes: DataFrame) -> DataFrame:
    """Convert ``rows(table_id, row_pos, cells ARRAY<STRING>)`` by the vote of their columns.

    Cells become ``STRUCT<kind, num, at, text>``; what does not fit the kind of its column is NULL.
    The votes of a table are gathered in one short list, so rows are shuffled once, by table.
    """
    kinds = votes.groupBy("table_id").agg(in_order(F.collect_list(F.struct("col_pos", "kind")), "kind").alias("kinds"))

    def convert(raw: Column, kind: Column) -> Column:
        return F.struct(
            kind.alias("kind"),
            F.when(kind == "number", let(to_float(raw), lambda v: F.when(~F.isnan(v), v))).alias("num"),
            F.when(kind == "timestamp", to_timestamp(raw)).alias("at"),
            F.when(kind == "text", raw).alias("text"),
        )

    return raw_rows.join(kinds, "table_id").select("table_id", "row_pos", F.zip_with("cells", "kinds", convert).alias("cells"))


def type_results(results: DataFrame, text: str = "result_text") -> DataFrame:
    """Read printed results: adds ``kind`` and ``entries``.

    Items stand between ``| `` marks and ``none`` is missing. The kind is ``empty``, ``int``, ``float``,
    ``bool`` (all ``t``, ``f`` or missing), ``number_list`` and ``list`` (items with ``,, `` inside), or ``text``.
    Entries are lists of texts, one per item, printed by their type; a plain item is a list of one.
    """
    line = F.col(text)
    items = F.transform(F.split(line, RESULT_MARK, -1), lambda i: F.when(i != "none", i))
    split = results.withColumn("items", F.when(strip(line) != "", items).otherwise(F.array().cast("array<string>")))

    def every(test) -> Column:
        return F.forall("items", lambda i: F.coalesce(test(i), F.lit(False)))

    lists = F.transform("items", lambda i: F.filter(F.split(i, LIST_MARK, -1), lambda p: (i != "") | (p != "")))
    kind = (
        F.when(F.size("items") == 0, F.lit("empty"))
        .when(every(is_strict_int), F.lit("int"))
        .when(every(is_strict_float), F.lit("float"))
        .when(every(lambda i: F.coalesce(i, F.lit("t")).isin("t", "f")), F.lit("bool"))
        .when(~F.exists("items", lambda i: F.coalesce(F.contains(i, F.lit(LIST_MARK)), F.lit(False))), F.lit("text"))
        .when(F.forall("lists", lambda x: F.coalesce(F.forall(x, is_strict_float), F.lit(True))), F.lit("number_list"))
        .otherwise(F.lit("list"))
    )
    judged = split.withColumn("lists", lists).withColumn("kind", kind)
    as_numbers = F.transform("lists", lambda x: F.transform(x, lambda i: float_text(to_float(i))))
    entries = (
        F.when(F.col("kind").isin("float", "number_list"), as_numbers)
        .when(F.col("kind") == "list", F.col("lists"))
        .otherwise(F.transform("items", lambda i: F.when(i.isNotNull(), F.array(i))))
    )
    return judged.withColumn("entries", entries).drop("items", "lists")
