"""Answers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions.numbers import float_text
from tablewright.operators.sketch import AGG_NAMES, OP_NAMES

# Marks between answers and between the items of a list answer.
ANSWER_MARK = "| "
LIST_MARK = ",, "


def all_whole(numbers: Column) -> Column:
    return F.forall(numbers, lambda x: F.coalesce((x == F.floor(x)) & ~F.isnan(x), F.lit(False)))


def numbers_text(numbers: Column, whole_answer: Column | None = None) -> Column:
    """``1| 2`` when every number is whole, else ``1.0| 2.5``; a missing number prints ``nan``.

    ``whole_answer`` says whether all numbers of the answer are, where ``numbers`` is only a segment of it.
    """
    whole_answer = all_whole(numbers) if whole_answer is None else whole_answer
    whole = F.transform(numbers, lambda x: x.cast("decimal(38,0)").cast("string"))
    return F.array_join(F.when(whole_answer, whole).otherwise(F.transform(numbers, float_text)), ANSWER_MARK, "nan")


def booleans_text(flags: Column) -> Column:
    return F.array_join(F.transform(flags, lambda b: F.when(b, F.lit("t")).otherwise(F.lit("f"))), ANSWER_MARK)


def texts_text(texts: Column) -> Column:
    return F.lower(F.array_join(texts, ANSWER_MARK, "none"))


def lists_text(lists: Column) -> Column:
    """Items of each list between ``,, ``; a missing list or item prints ``none``."""
    return texts_text(F.transform(lists, lambda x: F.array_join(x, LIST_MARK, "none")))


def collapse_answers(answers: Column) -> Column:
    """One entry when all answers are equal (a missing one counts as a value), else all of them."""
    return F.when(F.size(F.array_distinct(answers)) == 1, F.array_distinct(answers)).otherwise(answers)


def sketch_sql_text(sel: Column, agg: Column, conds: Column) -> Column:
    """A sketch as query text: ``SELECT MAX col2 FROM table WHERE col0 = "a" AND col1 > "3"``."""
    written = F.transform(
        conds,
        lambda c: F.concat(
            F.lit("col"),
            c["col"].cast("string"),
            F.lit(" "),
            F.get(F.array(*map(F.lit, OP_NAMES)), c["op"]),
            F.lit(' "'),
            c["value"],
            F.lit('"'),
        ),
    )
    where = F.concat(F.lit(" WHERE "), F.array_join(written, " AND "))
    return F.concat(
        F.lit("SELECT "),
        F.get(F.array(*map(F.lit, AGG_NAMES)), agg),
        F.lit(" col"),
        sel.cast("string"),
        F.lit(" FROM table"),
        F.when(F.size(conds) > 0, where).otherwise(F.lit("")),
    )


def same_sketch(sel: Column, agg: Column, conds: Column, sel2: Column, agg2: Column, conds2: Column) -> Column:
    """Same column, aggregate and set of conditions, values compared without case."""

    def as_set(entries: Column) -> Column:
        lowered = F.transform(entries, lambda c: F.struct(c["col"], c["op"], F.lower(c["value"])))
        return F.sort_array(F.array_distinct(lowered))

    return (sel == sel2) & (agg == agg2) & (as_set(conds) == as_set(conds2))
