"""The two conversions of raw examples into a data set, each as one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.corpus import Corpus
from tablewright.functions.binding import let
from tablewright.functions.numbers import to_float
from tablewright.operators.answers import sketch_sql_text
from tablewright.operators.linear import header_text, parse_linear, rename_headers, row_texts, split_question
from tablewright.operators.sketch import answer_sketches
from tablewright.operators.typing import to_timestamp
from tablewright.plans.shred import linearize_plans, reflect_depth, shred_plans
from tablewright.skew import BLOCK_ROWS, has_larger_group

# The texts of tables up to this many rows, a few segments each, stay where the table lies.
PLACED_ROWS = 16 * BLOCK_ROWS


def _column_kinds(read: Column) -> Column:
    """``number``, ``timestamp`` or ``text`` for every column of a parsed table, by its cells."""

    def kind(position: Column) -> Column:
        cells = F.transform(read["parsed"], lambda row: F.get(row, position))
        # NaN is above infinity.
        number = F.exists(cells, lambda c: to_float(c) <= F.lit(float("inf")))
        date = F.exists(cells, lambda c: to_timestamp(c).isNotNull())
        return F.when(number, F.lit("number")).when(date, F.lit("timestamp")).otherwise(F.lit("text"))

    return F.transform(read["header"], lambda _, i: kind(i))


def convert_pairs(lines: DataFrame) -> DataFrame:
    """Lines ``(line_no, question, answer, xml_plan)`` to ``(line_no, query_text, kinds, plan_text, answer, status)``.

    A question holds a query and a linear table. The query's header names become column numbers, columns get their kinds, the plan is
    written as text. ``status`` is ``ok`` or says what is wrong; count it with ``status_report`` and keep the rest with ``drop_failed``.
    """
    split = split_question(lines).withColumn("_table", F.explode_outer(F.array(let(F.col("linear_text"), parse_linear))))
    # The plan's text stands in a row of its own: a filter by status then does not read the plan a second time.
    planned = linearize_plans(reflect_depth(shred_plans(split))).withColumn("plan_text", F.explode_outer(F.array("plan_text")))
    status = (
        F.when(~F.col("split_ok"), F.lit("no table"))
        .when(F.col("_table.problem").isNotNull(), F.col("_table.problem"))
        .when(F.col("plan_text").isNull(), F.lit("no plan"))
        .otherwise(F.lit("ok"))
    )
    query = rename_headers(F.col("query_text"), F.col("_table.header")).alias("query_text")
    return planned.select("line_no", query, _column_kinds(F.col("_table")).alias("kinds"), "plan_text", "answer", status.alias("status"))


def _by_segment(left: DataFrame, right: DataFrame, keys: list[str], how: str, spread: bool) -> DataFrame:
    """A join on ``[*keys, "segment"]``. What lies by ``keys`` stays there, unless segments are to ``spread``."""
    if spread:
        return left.join(right, [*keys, "segment"], how)
    # A range of one segment is no key of the join: Spark then deals out by the other keys alone.
    theirs = right.withColumnsRenamed({k: f"right_{k}" for k in [*keys, "segment"]})
    equal = F.col("segment").between(F.col("right_segment"), F.col("right_segment"))
    for k in keys:
        equal &= F.col(k) == F.col(f"right_{k}")
    found = left.join(theirs, equal, how)
    merged = {k: F.coalesce(k, f"right_{k}") if how == "full" else F.col(k) for k in [*keys, "segment"]}
    return found.withColumns(merged).drop(*[f"right_{k}" for k in merged])


def convert_sketches(examples: DataFrame, corpus: Corpus, natural: DataFrame, queries: DataFrame | None = None, placed_rows: int = PLACED_ROWS) -> DataFrame:
    """Examples to ``(table_id, example_id, segment, query_text, answer, linear_text, natural_text, status)``.

    ``linear_text`` has the headers of the corpus, ``natural_text`` those of the column descriptions ``natural``. The query stands in segment 0;
    long tables and long list answers go on in later segments. ``status`` is that of the answer. With ``queries(example_id, query_text)`` their texts
    stand in every segment instead, and examples without one are left out.

    The rows of a table are printed once for both texts. All else is joined by keys, headers and answers; the printed rows come last. With tables
    of up to ``placed_rows`` rows they stay where the table lies, else they move once.
    """
    # With a long table, the segments of all are spread.
    spread = has_larger_group(corpus.rows.select("table_id").where("table_id IS NOT NULL"), ["table_id"], placed_rows)
    # Said here as the answers' join says it, so that Spark sorts the rows by table once for both. A missing table has no text.
    bodies = row_texts(corpus.rows.where("table_id IS NOT NULL"))
    at_start = F.lit(0).cast("long").alias("segment")
    head = lambda meta, name: meta.select("table_id", header_text(F.col("header")).alias(name), F.lit(True).alias(f"has_{name}"))
    heads = head(corpus.meta, "linear").join(head(natural, "natural"), "table_id", "full").select("*", at_start)
    filled = bodies.select("table_id", "segment", F.lit(True).alias("filled"))
    formed = _by_segment(heads, filled, ["table_id"], "full", spread)
    forms = formed.where("filled OR (has_linear AND has_natural)").select("table_id", "segment", "linear", "natural", F.lit(True).alias("formed"))
    asked = examples.select("table_id", "example_id", sketch_sql_text(F.col("sel"), F.col("agg"), F.col("conds")).alias("query_text"))
    answered = answer_sketches(examples, corpus)
    # The status of an example is that of any of its answers; one without an id has none.
    known = F.col("table_id").isNotNull() & F.col("example_id").isNotNull()
    failed = F.when(known, F.max(F.when(F.col("status") != "ok", F.col("status"))).over(W.partitionBy("table_id", "example_id")))
    joined = _by_segment(asked.join(forms, "table_id"), answered, ["table_id", "example_id"], "full", spread).withColumn("failed", failed).drop("status")
    if queries is None:
        named = joined.withColumn("query_text", F.when(F.col("segment") == 0, F.col("query_text")))
    else:
        named = joined.drop("query_text").join(queries, "example_id")
    text = lambda name: F.when(F.col("formed"), F.concat(F.coalesce(name, F.lit("")), F.coalesce("body", F.lit("")))).alias(f"{name}_text")
    status = F.coalesce("failed", F.lit("ok")).alias("status")
    # The printed rows are the large side: they are never broadcast.
    whole = _by_segment(named, bodies.hint("merge"), ["table_id"], "left", spread)
    return whole.select("table_id", "example_id", "segment", "query_text", "answer", text("linear"), text("natural"), status)
