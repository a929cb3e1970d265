"""The composed conversions over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators import answers, prep
from tablewright.operators.convert import convert_pairs, convert_sketches
from tablewright.operators.linear import linearize
from tablewright.queries import query
from tablewright.queries.plans import LINEARIZED_PLANS
from tablewright.queries.shared_sql import ORDER_LINES, SKETCH_ANSWERS
from tablewright.queries.tables import HEADER, NATURAL, SKETCH_TEXT, linear_sql
from tablewright.sources.driver_tables import order_corpus, order_plans, order_sketches, table


@query(
    f"""WITH {LINEARIZED_PLANS}, {ORDER_LINES}
    SELECT o_orderkey AS line_no, 'ask ' || o_orderpriority || ' ' AS query_text, ['number', 'number', 'number', 'number', 'text'] AS kinds,
      plan_text, o_orderpriority AS answer
    FROM orders JOIN linear_plans ON plan_id = o_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)"""
)
def convert_line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Orders without lines have no rows, and some have no plan; both are left out.
    corpus = order_corpus(spark, sf_dir)
    text = linearize(corpus.rows, corpus.meta).where("segment = 0").select(F.col("table_id").alias("line_no"), "linear_text")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("line_no"), F.col("o_orderpriority").alias("answer"))
    plans = order_plans(spark, sf_dir).withColumnRenamed("plan_id", "line_no")
    asked = F.concat(F.lit("ask "), "answer", F.col("linear_text"))
    # The documents are built from small columns and by far larger than Spark's estimate of them: they are never broadcast.
    lines = orders.join(text, "line_no").join(plans.hint("merge"), "line_no").withColumn("question", asked).drop("linear_text")
    return prep.drop_failed(convert_pairs(lines)).drop("status")


@query(
    f"""WITH {SKETCH_ANSWERS}, {linear_sql(HEADER)}, named AS (SELECT table_id AS named_id, replace(linear_text, ' col : {HEADER}',
        ' col : {' | '.join(NATURAL)}') AS natural_text FROM linear)
    SELECT s.ex AS example_id, 0::BIGINT AS segment, {SKETCH_TEXT.replace("sel", "s.sel").replace("agg", "s.agg")} AS query_text, answer, linear_text, natural_text
    FROM sketches s JOIN sketch_answers ON example_id = s.ex JOIN linear ON table_id = s.ex JOIN named ON named_id = s.ex
    WHERE NOT (s.sel = 4 AND s.agg = 0 AND s.ex IN (SELECT l_orderkey FROM lineitem))"""
)
def convert_order_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Some examples compare a number column with a word; they fail and are left out.
    examples = order_sketches(spark, sf_dir)
    wrong = F.array(F.struct(F.lit(1).alias("col"), F.lit(0).alias("op"), F.lit("many").alias("value")))
    spoiled = examples.withColumn("conds", F.when((F.col("sel") == 4) & (F.col("agg") == 0), wrong).otherwise(F.col("conds")))
    corpus = order_corpus(spark, sf_dir)
    natural = corpus.meta.withColumn("header", F.array(*map(F.lit, NATURAL)))
    asked = examples.select("example_id", answers.sketch_sql_text(F.col("sel"), F.col("agg"), F.col("conds")).alias("query_text"))
    done = prep.drop_failed(convert_sketches(spoiled, corpus, natural, asked))
    return done.select("example_id", "segment", "answer", "linear_text", "natural_text", "query_text")
