"""Data set preparation over documents, labels and orders, and the streaming forms."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators import prep
from tablewright.operators.sketch import answer_sketches
from tablewright.queries import query
from tablewright.skew import ensure_checkpoint_dir, row_positions
from tablewright.sources.driver_tables import order_corpus, order_sketches, spread, table
from tablewright.streaming import incremental


def _new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared place of the session."""
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


@query(
    """SELECT doc_id, CASE WHEN u < 0.2 THEN 'test' WHEN u < 0.4 THEN 'validation' ELSE 'train' END AS split
    FROM (SELECT doc_id, ('0x' || left(md5('17:' || doc_id), 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM documents)"""
)
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.ensure_splits(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", seed=17)


@query("SELECT doc_id, 'train' AS split FROM documents")
def all_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.as_train(table(spark, sf_dir, "documents").select("doc_id"))


@query(
    """SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents)
    WHERE r <= 50"""
)
def first_of_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.first_of_split(table(spark, sf_dir, "documents").select("doc_id", "lang"), 50, "doc_id", "lang")


@query(
    """SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS r FROM orders)
    WHERE r <= 5000"""
)
def first_of_split_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return prep.first_of_split(orders, 5000, "o_orderkey", "o_orderstatus")


_TOKENS = r"len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+'))::INTEGER"


@query(f"SELECT * FROM (SELECT doc_id, {_TOKENS} AS n_tokens FROM documents) WHERE n_tokens <= 200")
def length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return prep.within_length(documents, "text", 200).drop("text")


@query(f"SELECT lang, count(*) AS n, count(*) FILTER ({_TOKENS} <= 200) AS n_kept FROM documents GROUP BY lang")
def length_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread(table(spark, sf_dir, "documents").select("lang", "text"))
    return prep.length_report(documents, "text", 200, ["lang"])


@query(
    """SELECT doc_id, lang, source FROM documents WHERE (lang <> 'en' OR source < 'src15') AND n_chars <= 2000
      AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND doc_id IN (SELECT doc_id FROM labels)"""
)
def holdout_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    validation = [documents.where("lang <> 'en'").select("doc_id"), documents.where("source < 'src15'").select("doc_id")]
    train = [labels.where("toxic = 1").select("doc_id"), documents.where("n_chars > 2000").select("doc_id")]
    return prep.held_out(documents.select("doc_id", "lang", "source"), "doc_id", validation, train, labels)


@query(
    """SELECT line_no // 1000 AS chunk_id, line_no, o_orderkey, 'f' || md5(o_orderpriority || o_orderkey) AS table_name
    FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey, o_custkey, o_totalprice) - 1 AS line_no FROM orders)"""
)
def chunk_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    placed = row_positions(orders, [], ["o_orderkey", "o_custkey", "o_totalprice"], "line_no")
    lines = placed.withColumn("line_no", F.col("line_no") - 1)

    def convert(chunk: DataFrame) -> DataFrame:
        key = F.concat(F.lit("f"), F.md5(F.concat("o_orderpriority", F.col("o_orderkey").cast("string"))))
        return chunk.select("chunk_id", "line_no", "o_orderkey", key.alias("table_name"))

    # The first run stops after a few chunks, the second takes the rest.
    folder = _new_folder(spark, "chunks")
    prep.convert_chunks(lines, convert, folder, chunk_rows=1000, end_chunk=5)
    return prep.convert_chunks(lines, convert, folder, chunk_rows=1000)


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS line_no, o_orderkey FROM orders")
def chunk_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Before the lines as they are now came a run with other lines in some chunks, and one with lines beyond the last; chunks grow, shrink and are edited.
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    lines = row_positions(orders, [], ["o_orderkey"], "line_no").withColumn("line_no", F.col("line_no") - 1)
    folder = _new_folder(spark, "growth")
    keep = lambda chunk: chunk.select("chunk_id", "line_no", "o_orderkey")
    edited = F.when(F.col("line_no") % 5000 < 3, -F.col("o_orderkey")).otherwise(F.col("o_orderkey")).alias("o_orderkey")
    prep.convert_chunks(lines.where("line_no % 3000 <> 7").select("line_no", edited), keep, folder, chunk_rows=1000)
    more = lines.select((F.col("line_no") + 700).alias("line_no"), "o_orderkey")
    prep.convert_chunks(lines.unionByName(more.join(lines.select("line_no"), "line_no", "left_anti")), keep, folder, chunk_rows=1000)
    return prep.convert_chunks(lines, keep, folder, chunk_rows=1000).drop("chunk_id")


@query(
    """SELECT CASE WHEN o_orderkey % 4 = 2 AND (o_orderkey // 4) % 4 = 0
      AND o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN 'type_error' ELSE 'ok' END AS status, count(*) AS n
    FROM orders GROUP BY 1"""
)
def status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Queries that select the flag column and ask for nothing else compare quantities with a word here.
    examples = order_sketches(spark, sf_dir)
    wrong = F.array(F.struct(F.lit(1).alias("col"), F.lit(0).alias("op"), F.lit("many").alias("value")))
    spoiled = examples.withColumn(
        "conds", F.when((F.col("sel") == 4) & (F.col("agg") == 0), wrong).otherwise(F.col("conds"))
    )
    return prep.status_report(answer_sketches(spoiled, order_corpus(spark, sf_dir)))


@query(
    """WITH e AS (SELECT event_type, coalesce(pred, '') AS p, CAST((props->>'k')::BIGINT AS VARCHAR) AS r
      FROM (SELECT *, CASE WHEN event_id % 5 = 0 THEN NULL ELSE floor(value)::BIGINT::VARCHAR END AS pred FROM events)),
    d AS (SELECT *, levenshtein(p, r) AS d FROM e)
    SELECT event_type, count(*) AS samples, count(*) FILTER (p = r) / count(*) AS denotation_accuracy, sum(d) / count(*) AS distance_mean,
      sqrt((count(*) * sum(d * d) - sum(d) * sum(d))::DOUBLE) / count(*) AS distance_std,
      (SELECT d FROM d x WHERE x.event_type = d.event_type GROUP BY d ORDER BY count(*) DESC, d LIMIT 1)::INTEGER AS distance_mode
    FROM d GROUP BY event_type"""
)
def stream_event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every fifth prediction is missing.
    schema = table(spark, sf_dir, "events").schema
    events = incremental.arriving_files(spark, sf_dir, schema, "events.parquet")
    predictions = events.select(
        "event_type",
        F.when(F.col("event_id") % 5 != 0, F.floor("value").cast("string")).alias("pred"),
        F.get_json_object("props", "$.k").alias("ref"),
    )
    folder = _new_folder(spark, "scores")
    incremental.running_scores(predictions, ["event_type"], folder + "/out", folder + "/state").awaitTermination()
    return incremental.latest_scores(spark, folder + "/out", ["event_type"])


@query("SELECT event_id, event_type || ' ' || (props->>'k') AS question FROM events")
def stream_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    events = incremental.arriving_files(spark, sf_dir, schema, "events.parquet")

    def convert(arrived: DataFrame) -> DataFrame:
        return arrived.select("event_id", F.concat_ws(" ", "event_type", F.get_json_object("props", "$.k")).alias("question"))

    folder = _new_folder(spark, "converted")
    incremental.convert_arriving(events, convert, folder + "/out", folder + "/state").awaitTermination()
    return spark.read.parquet(folder + "/out").drop("batch_id")
