"""Operators on a table with the corpus rules for missing and mixed values."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.functions.numbers import float_or_null
from tablewright.skew import BLOCK_ROWS, HOT_ROWS, block_of, in_order, row_positions, sort_columns

# Spark's own limit for cutting groups before the shuffle, and the pieces that a group is cut in beyond it.
GROUP_LIMIT = 1000
PIECES = 64

# --- projection and predicates ---


def project(df: DataFrame, *columns: str, total: str = "agg") -> DataFrame:
    """The columns of ordinary rows: rows marked as totals (``total`` other than 0) are left out."""
    return df.where(F.col(total) == 0).select(*columns)


def equals_literal(df: DataFrame, column: str, literal: str) -> DataFrame:
    """Rows whose column equals the literal. ``none`` that matches no row asks for missing values instead."""
    if literal != "none":
        return df.where(F.col(column) == literal)
    found = df.where(F.col(column) == literal).limit(1).agg(F.count("*").alias("n"))
    return df.where(
        F.when(found.scalar() > 0, F.coalesce(F.col(column) == literal, F.lit(False))).otherwise(F.col(column).isNull())
    )


def differs(column: Column, value) -> Column:
    """Not equal; a missing value does not count as different."""
    return F.coalesce(column != value, F.lit(False))


def text_compare(column: Column, op: str, number: float) -> Column:
    """Compare text with a number: cells that are no numbers do not match."""
    value = float_or_null(column)
    test = {"<": value < number, "<=": value <= number, ">": value > number, ">=": value >= number}[op]
    return F.coalesce(test, F.lit(False))


def is_in(column: Column, values: Iterable) -> Column:
    """Membership; a missing value is not a member."""
    return F.coalesce(column.isin(*values), F.lit(False))


# --- list columns: one verdict per list ---


def any_equal(values: Column, value) -> Column:
    return F.coalesce(F.exists(values, lambda x: F.coalesce(x == value, F.lit(False))), F.lit(False))


def any_differs(values: Column, value) -> Column:
    """A missing entry differs from every value."""
    return F.exists(values, lambda x: ~x.eqNullSafe(F.lit(value)))


def any_in(values: Column, members: Iterable) -> Column:
    members = list(members)
    return F.exists(values, lambda x: F.coalesce(x.isin(*members), F.lit(False)))


def all_compare(values: Column, op: str, value) -> Column:
    """True when every entry passes; a missing entry does not pass."""

    def test(x: Column) -> Column:
        return {"<": x < value, "<=": x <= value, ">": x > value, ">=": x >= value}[op]

    return F.forall(values, lambda x: F.coalesce(test(x), F.lit(False)))


# --- grouping ---


def group_lists(
    df: DataFrame, keys: list[str], value: str, order: list[str], block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``(keys, block, values)``: the values of each group in row order, missing values kept.

    Missing keys are dropped. A list holds at most ``block_rows`` values; larger groups have several
    blocks, in order.
    """
    keyed = df.dropna(subset=keys).select(*dict.fromkeys([*keys, value, *(c.lstrip("-") for c in order)]))
    numbered = row_positions(keyed, keys, order, "_pos")
    entry = F.struct("_pos", F.col(value).alias("value"))
    blocks = numbered.groupBy(*keys, block_of(F.col("_pos"), block_rows).alias("block"))
    return blocks.agg(in_order(F.collect_list(entry), "value").alias("values"))


def list_verdicts(
    blocks: DataFrame,
    keys: list[str],
    any_of: dict[str, Column] | None = None,
    all_of: dict[str, Column] | None = None,
    greatest: dict[str, Column] | None = None,
    least: dict[str, Column] | None = None,
) -> DataFrame:
    """One row for each group from tests of its blocks of values: one block has to pass, or all, or the greatest or least counts.

    The verdict is that of the whole list, however many blocks it comes in.
    """
    ways = [(any_of, F.bool_or), (all_of, F.bool_and), (greatest, F.max), (least, F.min)]
    return blocks.groupBy(*keys).agg(*[way(test).alias(name) for tests, way in ways for name, test in (tests or {}).items()])


def list_distinct_count(blocks: DataFrame, keys: list[str], values: Column, name: str = "n_distinct") -> DataFrame:
    """How many different values the lists of each group hold over all its blocks; missing ones are not counted."""
    held = blocks.select(*keys, F.explode_outer(F.array_distinct(values)).alias("_value")).distinct()
    return held.groupBy(*keys).agg(F.count("_value").alias(name))


def group_verdicts(df: DataFrame, keys: list[str], **tests: Column) -> DataFrame:
    """One boolean per group and test, from row tests marked with ``any_row`` or ``all_rows``."""
    return df.dropna(subset=keys).groupBy(*keys).agg(*[test.alias(name) for name, test in tests.items()])


def any_row(test: Column) -> Column:
    """True when the test holds for some row of the group."""
    return F.bool_or(F.coalesce(test, F.lit(False)))


def all_rows(test: Column) -> Column:
    """True when the test holds for every row of the group; a missing result fails it."""
    return F.bool_and(F.coalesce(test, F.lit(False)))


def total(column: Column) -> Column:
    """Sum of what reads as a number; 0 when nothing does."""
    return F.coalesce(F.sum(column), F.lit(0.0))


def text_total(column: Column) -> Column:
    return total(float_or_null(column))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).dropna().distinct()


def list_distinct(lists: Column) -> Column:
    """Distinct values over the lists of one row, missing ones dropped."""
    return F.array_compact(F.array_distinct(F.flatten(lists)))


def list_union(left: Column, right: Column) -> Column:
    return F.array_union(left, right)


def list_intersect(left: Column, right: Column) -> Column:
    """Entries of the left list found on the right, duplicates kept; missing matches missing."""
    return F.filter(left, lambda x: F.exists(right, lambda y: x.eqNullSafe(y)))


def having(groups: DataFrame, *tests: Column, either: bool = False) -> DataFrame:
    """Keep groups passing all tests, or any of them with ``either``."""
    verdict = F.lit(not either)
    for test in tests:
        passed = F.coalesce(test, F.lit(False))
        verdict = (verdict | passed) if either else (verdict & passed)
    return groups.where(verdict)


def collapse_groups(df: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """Groups whose values are all equal keep their first row, other groups keep all rows."""
    column = F.col(value)
    spread = df.groupBy(*keys).agg(
        ((F.count(column) == F.count("*")) & (F.min(column) == F.max(column)) | (F.count(column) == 0)).alias("_equal"),
        F.min(position).alias("_first"),
    )
    kept = df.join(spread, keys).where(~F.coalesce("_equal", F.lit(False)) | (F.col(position) == F.col("_first")))
    return kept.drop("_equal", "_first")


# --- order and limit ---


def ordered(
    df: DataFrame, value: str, by: str, tie: list[str], keys: list[str] | None = None, descending: bool = False
) -> DataFrame:
    """Number rows by ``by``, dropping rows that miss ``value`` or ``by``; adds ``rank`` from 1.

    Equal rows keep the order of the tie columns, and are reversed when descending.
    """
    sign = "-" if descending else ""
    return row_positions(df.dropna(subset=[value, by]), keys or [], [sign + by, *(sign + t for t in tie)], "rank")


def top_rows(df: DataFrame, k: int, order: list[str]) -> DataFrame:
    """The first ``k`` rows in order with their ``rank``; only k rows per task are kept on the way."""
    top = df.orderBy(*sort_columns(order)).limit(k)
    if k > HOT_ROWS:
        return row_positions(top, [], order, "rank")
    # At most k rows reach this window.
    return top.withColumn("rank", F.row_number().over(W.orderBy(*sort_columns(order))).cast("long"))


def top_per_group(df: DataFrame, keys: list[str], k: int, order: list[str]) -> DataFrame:
    """The first ``k`` rows of every group with their ``rank``.

    Up to ``GROUP_LIMIT`` rows Spark cuts the groups before the shuffle. Beyond, a group is cut in pieces by a hash of its rows first, so
    that no task sorts more of it than a piece or ``PIECES * k`` rows.
    """
    if k > GROUP_LIMIT:
        piece = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(PIECES))
        inside = W.partitionBy(*keys, "_piece").orderBy(*sort_columns(order))
        df = df.withColumn("_piece", piece).withColumn("_at", F.row_number().over(inside)).where(F.col("_at") <= k).drop("_piece", "_at")
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*sort_columns(order))))
    return ranked.where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def order_groups(df: DataFrame, keys: list[str], by: Column, descending: bool = False) -> DataFrame:
    """All rows, with the ``group_rank`` of their group by an aggregate (ties by key)."""
    groups = df.groupBy(*keys).agg(by.alias("_by")).dropna(subset=["_by"])
    sign = "-" if descending else ""
    ranked = row_positions(groups, [], [sign + "_by", *keys], "group_rank").drop("_by")
    return df.join(ranked, keys)


# --- sets ---


def union_distinct(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right).distinct()


def bag_intersect(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Rows of the left found on the right, duplicates kept; missing matches missing."""
    members = right.select(F.col(column).alias("_member")).distinct()
    return left.join(members, F.col(column).eqNullSafe(F.col("_member")), "left_semi")


def except_ids(kept: list[DataFrame], removed: list[DataFrame]) -> DataFrame:
    """Ids in any of ``kept`` and in none of ``removed``."""
    first, *rest = kept
    gone, *more = removed
    for ids in rest:
        first = first.unionByName(ids)
    for ids in more:
        gone = gone.unionByName(ids)
    return first.distinct().join(gone.distinct(), first.columns, "left_anti")


# --- arithmetic ---


def divide(left: Column, right: Column) -> Column:
    """Quotient; NULL for a zero divisor."""
    return F.try_divide(left, right)


def text_arithmetic(left: Column, op: str, right: Column) -> Column:
    """``+``, ``-`` or ``/`` of two text columns read as numbers."""
    a, b = float_or_null(left), float_or_null(right)
    return {"+": a + b, "-": a - b, "/": F.try_divide(a, b)}[op]


def one_value(df: DataFrame, value: Column) -> Column:
    """An aggregate of a DataFrame as a value for arithmetic; a result over no rows counts as 0."""
    return F.coalesce(df.agg(value.alias("v")).scalar(), F.lit(0.0))


# --- mergeable distinct counts ---

# The logarithm of the registers of a sketch: 2^14 of them, 16 KB at most, tell counts with a standard error of about 0.8 %.
SKETCH_BITS = 14


def distinct_sketches(df: DataFrame, keys: list[str], value: str, bits: int = SKETCH_BITS) -> DataFrame:
    """``keys, n_rows, sketch`` of the different values per key (missing ones do not count), to be kept and merged without the rows.

    A key's rows are sketched before the shuffle, so a key of any size sends one sketch from each task. A key without any value has an empty sketch.
    """
    kind = dict(df.dtypes)[value]
    held = F.col(value) if kind in ("int", "bigint", "string", "binary") else F.col(value).cast("string")
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.hll_sketch_agg(held, F.lit(bits)).alias("sketch"))


def merge_distinct(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n_rows, n_distinct`` from the sketches of any parts: chunks, days, files. A value that several parts hold counts once."""
    merged = sketches.groupBy(*keys).agg(F.sum("n_rows").alias("n_rows"), F.hll_union_agg("sketch").alias("sketch"))
    return merged.select(*keys, "n_rows", F.hll_sketch_estimate("sketch").alias("n_distinct"))
