"""Tables as one line of text and back, and the query text that travels with them.

A linear table reads `` col : a | b row 1 : 1 | x row 2 : 2 | y``. A table longer than a block of rows
is written in segments; joining its segments in order, with nothing between, gives its whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.text import strip, strip_simple
from tablewright.functions.binding import let
from tablewright.skew import BLOCK_ROWS, block_of, in_order

# The marks of the linear form.
COLUMN_MARK = " col : "
CELL_MARK = " | "
ROW_PATTERN = r" row \d+ : "
MISSING_CELL = "none"


def row_text(row_pos: Column, cells: Column) -> Column:
    """One row of a table of ``STRUCT<raw, num>`` cells in linear form."""
    texts = F.array_join(cells["raw"], CELL_MARK, MISSING_CELL)
    return F.concat(F.lit(" row "), row_pos.cast("string"), F.lit(" : "), texts)


def header_text(header: Column) -> Column:
    return F.concat(F.lit(COLUMN_MARK), F.array_join(header, CELL_MARK))


def row_texts(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(table_id, segment, body)``: the rows of every table in linear form, by blocks."""
    pieces = rows.select(
        "table_id",
        block_of(F.col("row_pos"), block_rows).alias("segment"),
        F.struct("row_pos", row_text(F.col("row_pos"), F.col("cells")).alias("text")).alias("piece"),
    )
    return pieces.groupBy("table_id", "segment").agg(
        F.array_join(in_order(F.collect_list("piece"), "text"), "").alias("body")
    )


def linearize(rows: DataFrame, meta: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(table_id, segment, linear_text)``; the header opens segment 0, a table without rows is its header.

    ``meta`` gives the header to print, so another ``meta`` for the same rows swaps the column names.
    """
    body = row_texts(rows, block_rows)
    head = meta.select("table_id", F.lit(0).cast("long").alias("segment"), header_text(F.col("header")).alias("head"))
    text = F.concat(F.coalesce("head", F.lit("")), F.coalesce("body", F.lit("")))
    return head.join(body, ["table_id", "segment"], "full").select("table_id", "segment", text.alias("linear_text"))


def parse_linear(line: Column) -> Column:
    """Read linear text, or a segment of it: ``STRUCT<header, first_row, parsed, problem>``.

    ``parsed`` is the list of rows, each a list of trimmed cells. ``problem`` is ``no header``,
    ``no rows``, ``ragged`` (rows of unequal width) or NULL.
    """

    def trimmed(cells: Column) -> Column:
        return F.transform(F.split(cells, r" \| ", -1), strip_simple)

    has_header = line.startswith(" col :")
    header = F.when(has_header, trimmed(F.regexp_extract(line, r"(?s)^ col :(.*?)(?= row 1 : |\z)", 1)))
    row_number = F.regexp_extract(line, r"^ row (\d+) : ", 1).try_cast("long")
    first_row = F.when(has_header, F.lit(1).cast("long")).otherwise(row_number)
    rows = let(
        F.split(line, ROW_PATTERN, -1),
        lambda parts: F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), trimmed),
    )

    def judged(read: Column) -> Column:
        width = F.coalesce(F.size(read["header"]), F.size(F.get(read["parsed"], F.lit(0))))
        problem = (
            F.when(read["first_row"].isNull(), F.lit("no header"))
            .when(F.size(read["parsed"]) == 0, F.lit("no rows"))
            .when(F.exists(read["parsed"], lambda r: F.size(r) != width), F.lit("ragged"))
        )
        return read.withField("problem", problem)

    return let(F.struct(header.alias("header"), first_row.alias("first_row"), rows.alias("parsed")), judged)


def delinearize(tables: DataFrame, text: str = "linear_text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Split ``(table_id, linear_text)`` into raw rows, headers and unreadable tables.

    Returns ``rows(table_id, row_pos, cells ARRAY<STRING>)``, ``headers(table_id, header)`` and
    ``bad(table_id, problem)``. Nothing is raised and nothing is lost.
    """

    def numbered(read: Column) -> Column:
        rows = F.transform(
            read["parsed"], lambda cells, i: F.struct((read["first_row"] + i).alias("row_pos"), cells.alias("cells"))
        )
        return F.when(read["problem"].isNull(), rows)

    line = F.col(text)
    # The outer form and the filters on what it yields keep Spark from parsing a text more than once.
    rows = tables.select("table_id", F.inline_outer(let(parse_linear(line), numbered))).where("row_pos IS NOT NULL")
    judged = tables.select("table_id", F.explode_outer(F.array(parse_linear(line))).alias("read"))
    headers = judged.where("read.problem IS NULL AND read.header IS NOT NULL").select("table_id", "read.header")
    return rows, headers, judged.where("read.problem IS NOT NULL").select("table_id", "read.problem")


def split_question(questions: DataFrame, question: str = "question", segment: str | None = None) -> DataFrame:
    """Split ``query col : table`` in two: adds ``query_text``, ``linear_text`` and ``split_ok``.

    The column mark has to appear exactly once; otherwise both parts are NULL. Where a question comes in segments (``segment`` counts
    them from 0), the first holds the query and the mark, and the others are pieces of the table as they are.
    """
    parts = F.split(F.col(question), COLUMN_MARK, -1)
    ok = F.size(parts) == 2
    if segment is not None:
        later = F.col(segment) > 0
        return questions.withColumns(
            {
                "split_ok": later | F.coalesce(ok, F.lit(False)),
                "query_text": F.when(~later & ok, strip(F.get(parts, F.lit(0)))),
                "linear_text": F.when(later, F.col(question)).when(ok, F.concat(F.lit(COLUMN_MARK), F.get(parts, F.lit(1)))),
            }
        )
    return questions.withColumns(
        {
            "split_ok": F.coalesce(ok, F.lit(False)),
            "query_text": F.when(ok, strip(F.get(parts, F.lit(0)))),
            "linear_text": F.when(ok, F.concat(F.lit(COLUMN_MARK), F.get(parts, F.lit(1)))),
        }
    )


def rename_headers(query_text: Column, header: Column) -> Column:
    """Replace header names in a query by ``col_i``, the longest name first.

    A name counts where it stands between spaces. A bare ``not null`` becomes ``is not null``.
    """
    named = F.transform(header, lambda h, i: F.struct((-F.length(h)).alias("rank"), h.alias("name"), i.alias("at")))
    return F.aggregate(
        F.sort_array(named),
        F.concat(strip(query_text), F.lit(" ")),
        lambda text, h: F.replace(
            text,
            F.concat(F.lit(" "), h["name"], F.lit(" ")),
            F.concat(F.lit(" col_"), h["at"].cast("string"), F.lit(" ")),
        ),
        _spell_not_null,
    )


def _spell_not_null(text: Column) -> Column:
    spelled = F.contains(text, F.lit(" is not null"))
    return F.when(spelled, text).otherwise(F.replace(text, F.lit(" not null"), F.lit(" is not null")))


def token_query_text(query_tokens: Column) -> Column:
    """Query text from tokens given as ``[kind, token, ...]``."""
    return F.array_join(F.transform(query_tokens, lambda t: F.get(t, F.lit(1))), " ")
