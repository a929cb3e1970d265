"""What the sinks write to the session's shared folder and the readers read back."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.numbers import float_text
from tablewright.operators import answers, scoring
from tablewright.queries import query
from tablewright.queries.shared_sql import ORDER_LINES, ORDER_SKETCHES
from tablewright.queries.tables import SKETCH_TEXT
from tablewright.skew import ensure_checkpoint_dir
from tablewright.sources import datasets
from tablewright.sources.driver_tables import order_lines, order_sketches, table


def _folder(spark: SparkSession, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS line_no, 'ask ' || o_orderkey AS question, o_orderpriority AS answer FROM orders")
def line_pair_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").orderBy("o_orderkey")
    questions, found = _folder(spark, "questions"), _folder(spark, "answers")
    orders.select(F.concat(F.lit(" ask "), F.col("o_orderkey").cast("string"), F.lit("\t")).alias("value")).write.text(questions)
    orders.select(F.col("o_orderpriority").alias("value")).write.text(found)
    return datasets.read_line_pairs(spark, questions, found)


@query(f"WITH {ORDER_SKETCHES} SELECT ex::VARCHAR AS table_id, 'q' || ex AS question, {SKETCH_TEXT} AS query_text FROM sketches")
def question_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every other question has its conditions as an object of lists.
    sketches = order_sketches(spark, sf_dir)
    named = {"column_index": "conds.col", "operator_index": "conds.op", "condition": "conds.value"}
    lists = F.struct(*[F.col(field).alias(name) for name, field in named.items()])
    rows = F.transform("conds", lambda c: F.array(c["col"].cast("string"), c["op"].cast("string"), c["value"]))
    key = F.col("table_id").cast("string")

    def line(conds):
        sql = F.struct("sel", "agg", conds.alias("conds"))
        return F.to_json(F.struct(key.alias("table_id"), F.concat(F.lit("q"), key).alias("question"), sql.alias("sql")))

    path = _folder(spark, "sketches")
    sketches.select(F.when(F.col("table_id") % 2 == 0, line(rows)).otherwise(line(lists)).alias("value")).write.text(path)
    read = datasets.read_questions(spark, path)
    text = answers.sketch_sql_text(F.col("sel"), F.col("agg"), F.col("conds"))
    return read.select("table_id", "question", text.alias("query_text"))


@query("SELECT o_orderkey, o_orderpriority || ', \"' || o_orderstatus AS note, 'train' AS split FROM orders")
def csv_split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.concat("o_orderpriority", F.lit(', "'), "o_orderstatus").alias("note")
    path = _folder(spark, "split") + ".csv"
    table(spark, sf_dir, "orders").select("o_orderkey", note).write.option("header", True).option("escape", '"').csv(path)
    return datasets.read_split(spark, path, "train", "o_orderkey long, note string")


@query("SELECT o_orderkey AS id, o_orderpriority AS name FROM orders")
def json_array_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One array for each customer, one line each.
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name")).alias("entry"))
    path = _folder(spark, "arrays")
    orders.groupBy("o_custkey").agg(F.to_json(F.collect_list("entry")).alias("value")).select("value").write.text(path)
    return datasets.read_json_arrays(spark, path, "id long, name string")


@query("SELECT o_orderkey, o_orderpriority || ', \"' || o_orderstatus AS note, 'dev' AS split FROM orders")
def json_split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.concat("o_orderpriority", F.lit(', "'), "o_orderstatus").alias("note")
    path = _folder(spark, "split") + ".json"
    datasets.write_json(table(spark, sf_dir, "orders").select("o_orderkey", note), path)
    return datasets.read_split(spark, path, "dev", "o_orderkey long, note string")


@query(
    f"""WITH {ORDER_LINES} SELECT l_orderkey::VARCHAR AS table_id, row_pos, [l_quantity::VARCHAR, l_returnflag] AS cells,
      ['quantity', 'flag "x"'] AS header, ['real', 'text'] AS types FROM order_lines"""
)
def table_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One JSON line for each order: its rows in order, its column names and their types.
    lines = order_lines(spark, sf_dir)
    row = F.struct("row_pos", F.array(float_text(F.col("l_quantity")), F.col("l_returnflag")).alias("cells"))
    tables = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    header, types = F.array(F.lit("quantity"), F.lit('flag "x"')), F.array(F.lit("real"), F.lit("text"))
    whole = F.struct(F.col("l_orderkey").cast("string").alias("id"), header.alias("header"), types.alias("types"), F.col("rows.cells").alias("rows"))
    path = _folder(spark, "tables")
    tables.select(F.to_json(whole).alias("value")).write.text(path)
    rows, meta = datasets.read_tables(spark, path)
    return rows.join(meta, "table_id")


@query(
    r"""SELECT o_orderkey::VARCHAR AS id, [o_orderpriority || '|' || chr(10), 'b\'] AS "values", [o_orderkey::VARCHAR, '2'] AS canonical FROM orders"""
)
def tagged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    fields = [key, F.concat("o_orderpriority", F.lit("\\p\\n|b\\\\")), F.concat(key, F.lit("|2"))]
    names = ["id", "targetValue", "targetCanon"]
    rows = table(spark, sf_dir, "orders").select(*[f.alias(n) for f, n in zip(fields, names, strict=True)])
    path = _folder(spark, "tagged")
    rows.write.option("sep", "\t").option("header", True).option("quote", "").option("escape", "").csv(path)
    return datasets.read_tagged_answers(spark, path)


@query("SELECT o_orderkey, 'pred: ' || o_orderpriority || ' ref: ' || o_orderstatus AS line FROM orders")
def dataset_and_report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("pred"), F.col("o_orderstatus").alias("ref"))
    kept, as_json = _folder(spark, "dataset"), _folder(spark, "metrics")
    datasets.write_dataset(orders, kept)
    read = datasets.read_dataset(spark, kept)
    datasets.write_metrics(read, as_json)
    back = spark.read.schema(orders.schema).json(as_json)
    return back.select("o_orderkey", scoring.prediction_line(F.col("pred"), F.col("ref")).alias("line"))


@query("SELECT o_orderkey AS example_id, 'number' AS kind, o_totalprice AS num, lower(o_orderpriority) AS norm FROM orders")
def target_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.array("o_orderpriority").alias("values"), F.array(F.col("o_totalprice").cast("string")).alias("canonical")
    )
    value = F.get(F.col("target"), F.lit(0))
    read = scoring.target_values(tagged)
    return read.select(F.col("o_orderkey").alias("example_id"), value["key"]["kind"].alias("kind"), value["key"]["num"].alias("num"), value["norm"].alias("norm"))
