"""Reading and writing the files of a corpus: line pairs, JSON, tagged fields, data sets and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tablewright.functions.text import strip, unescape_list
from tablewright.operators.scoring import prediction_line

QUESTION_SCHEMA = "table_id string, question string, sql struct<sel:int,agg:int,conds:string>"
# Conditions come as a list of [column, operator, value], or as an object of three lists.
CONDS_AS_ROWS = "array<array<string>>"
CONDS_AS_LISTS = "struct<column_index:array<int>,operator_index:array<int>,condition:array<string>>"
TABLE_SCHEMA = "id string, header array<string>, types array<string>, rows array<array<string>>"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists, on whatever file system the path names."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


# --- lines ---


def read_lines(spark: SparkSession, path: str, name: str = "line") -> DataFrame:
    """``(line_no, name)``: trimmed lines numbered from 0, files in name order.

    Lines are numbered inside each piece of a file as it is scanned; pieces are counted once, and each
    line is shifted by the lines of the pieces before its own.
    """
    piece = ["file", "start"]
    scanned = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"),
        F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias(name),
    )
    counted = scanned.groupBy(*piece).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    # One row per piece of a file (128 MB by default), so this window sees few rows.
    before = W.orderBy(*piece).rowsBetween(W.unboundedPreceding, -1)
    offsets = counted.select(*piece, "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return scanned.join(offsets, piece).select((F.col("offset") + F.col("at") - F.col("first")).alias("line_no"), name)


def read_line_pairs(spark: SparkSession, question_path: str, answer_path: str) -> DataFrame:
    """``(line_no, question, answer)`` from two files with one entry per line."""
    questions, answers = read_lines(spark, question_path, "question"), read_lines(spark, answer_path, "answer")
    return questions.join(answers, "line_no")


# --- JSON ---


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Sketch examples from JSON lines: ``(example_id, table_id, question, sel, agg, conds)``; the id is the line number."""
    lines = read_lines(spark, path)
    raw = lines.select(F.col("line_no").alias("example_id"), F.from_json("line", QUESTION_SCHEMA).alias("q"))
    given = F.col("q.sql.conds")
    rows = F.transform(
        F.from_json(given, CONDS_AS_ROWS),
        lambda c: F.struct(c[0].cast("int").alias("col"), c[1].cast("int").alias("op"), c[2].alias("value")),
    )
    lists = F.from_json(given, CONDS_AS_LISTS)
    zipped = F.transform(
        F.arrays_zip(lists["column_index"], lists["operator_index"], lists["condition"]),
        lambda c: F.struct(c["column_index"].alias("col"), c["operator_index"].alias("op"), c["condition"].alias("value")),
    )
    conds = F.when(F.ltrim(given).startswith("{"), zipped).otherwise(rows)
    return raw.select("example_id", "q.table_id", "q.question", "q.sql.sel", "q.sql.agg", conds.alias("conds"))


def read_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Raw rows ``(table_id, row_pos, cells ARRAY<STRING>)`` and ``meta`` from JSON lines, one table each."""
    tables = spark.read.schema(TABLE_SCHEMA).json(path).withColumnRenamed("id", "table_id")
    rows = tables.select("table_id", F.posexplode("rows").alias("at", "cells"))
    meta = tables.select("table_id", "header", "types")
    return rows.select("table_id", (F.col("at") + 1).cast("long").alias("row_pos"), "cells"), meta


def read_json_array(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Entries of a file that holds one JSON array."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def read_json_arrays(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Entries of files with one JSON array a line. Lines are split over tasks, so an array is bounded by a line, not the file by a task.

    Empty arrays and lines that hold no array have no entries.
    """
    entry = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.read.text(path).select(F.inline(F.from_json("value", T.ArrayType(entry))))


# --- tables of examples ---


def read_split(
    spark: SparkSession, path: str, split: str, schema: str | T.StructType | None = None, multi_line: bool = False
) -> DataFrame:
    """A split from a ``.csv`` or ``.json`` file; other extensions are refused.

    Give the ``schema``: without one JSON is read twice to find it, and CSV columns are texts. Only ``multi_line`` CSV may hold line ends
    inside fields; it makes a task of each file, where plain CSV is split.
    """
    extension = path.rsplit(".", 1)[-1]
    if extension not in ("csv", "json"):
        raise ValueError(f"a split is read from a csv or json file, not {path!r}")
    if extension == "csv":
        data = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line).csv(path, schema=schema)
    else:
        data = spark.read.json(path, schema=schema)
    return data.withColumn("split", F.lit(split))


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_dataset(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def read_tagged_answers(spark: SparkSession, path: str) -> DataFrame:
    """``(id, values, canonical)`` from tab-separated fields with a header; lists are joined by bars."""
    raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("escape", "").csv(path)
    return raw.select(
        "id", unescape_list(F.col("targetValue")).alias("values"), unescape_list(F.col("targetCanon")).alias("canonical")
    )


# --- results ---


def write_prediction_lines(predictions: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``pred: x ref: y`` text lines."""
    predictions.select(prediction_line(F.col("pred"), F.col("ref")).alias("value")).write.mode(mode).text(path)


def write_predictions(predictions: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One trimmed prediction per line."""
    predictions.select(strip(F.col("pred")).alias("value")).write.mode(mode).text(path)


def write_metrics(summary: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The summary table as JSON, one object per checkpoint."""
    summary.write.mode(mode).json(path)
