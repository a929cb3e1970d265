"""Sketch queries over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators.sketch import answer_sketches
from tablewright.queries import query
from tablewright.queries.shared_sql import SKETCH_ANSWERS
from tablewright.sources.driver_tables import order_corpus, order_sketches


@query(f"WITH {SKETCH_ANSWERS} SELECT example_id, 0::BIGINT AS segment, answer, 'ok' AS status FROM sketch_answers")
def sketch_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_sketches(order_sketches(spark, sf_dir), order_corpus(spark, sf_dir)).drop("table_id")


@query(f"WITH {SKETCH_ANSWERS} SELECT example_id, answer, 'ok' AS status FROM sketch_answers")
def sketch_answers_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Tables in blocks of two rows: the route of very large tables, its list answers joined again.
    parts = answer_sketches(order_sketches(spark, sf_dir), order_corpus(spark, sf_dir), block_rows=2)
    answer = F.sort_array(F.collect_list(F.struct("segment", "answer")))["answer"]
    return parts.groupBy("example_id").agg(F.array_join(answer, ", ").alias("answer"), F.max("status").alias("status"))
