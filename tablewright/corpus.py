"""The corpus layout: many small tables in two long DataFrames.

``rows(table_id, row_pos, cells ARRAY<STRUCT<raw STRING, num DOUBLE>>)`` holds one table row per
row, positions counting from 1; ``meta(table_id, header ARRAY<STRING>, types ARRAY<STRING>)`` holds
one row per table, types being ``real`` or ``text``. ``num`` is the value of a ``real`` cell.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.numbers import loose_float


@dataclass(frozen=True)
class Corpus:
    """Rows and column descriptions of many tables. ``hot``: whether a table has more than ``skew.HOT_ROWS`` rows, where that is known."""

    rows: DataFrame
    meta: DataFrame
    hot: bool | None = None


def typed_cell(raw: Column, declared: Column) -> Column:
    """A cell with its number, when its column is declared ``real``."""
    return F.struct(raw.alias("raw"), F.when(declared == "real", loose_float(raw)).alias("num"))


def type_rows(raw_rows: DataFrame, meta: DataFrame) -> DataFrame:
    """Give ``rows(table_id, row_pos, cells ARRAY<STRING>)`` their numbers by the declared types.

    Text of ``text`` columns is kept as it is. The join is by table; AQE splits a table that is
    much larger than the others.
    """
    joined = raw_rows.join(meta.select("table_id", "types"), "table_id")
    cells = F.zip_with("cells", "types", typed_cell)
    return joined.select("table_id", "row_pos", cells.alias("cells"))


def lower_text_cells(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """Lower-case the cells of ``text`` columns; ``real`` cells are left alone."""
    joined = rows.join(meta.select("table_id", "types"), "table_id")
    cells = F.zip_with(
        "cells",
        "types",
        lambda cell, kind: F.struct(
            F.when(kind == "text", F.lower(cell["raw"])).otherwise(cell["raw"]).alias("raw"), cell["num"].alias("num")
        ),
    )
    return joined.select("table_id", "row_pos", cells.alias("cells"))


def raw_cells(rows: DataFrame) -> DataFrame:
    """One row per cell of text rows: ``(table_id, row_pos, col_pos, raw)``, columns counting from 0."""
    # The outer form keeps Spark from building every list twice, once to test it for emptiness.
    cells = rows.select("table_id", "row_pos", F.posexplode_outer("cells").alias("col_pos", "raw"))
    return cells.where("col_pos IS NOT NULL")


def to_cells(rows: DataFrame) -> DataFrame:
    """One row per cell: ``(table_id, row_pos, col_pos, raw, num)``, columns counting from 0."""
    return raw_cells(rows).select("table_id", "row_pos", "col_pos", "raw.raw", "raw.num")
