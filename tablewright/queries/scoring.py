"""Scores of predictions derived from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.normalize import fuzz_ratio, normalize_text
from tablewright.functions.numbers import float_text
from tablewright.operators import scoring
from tablewright.queries import query
from tablewright.sources.driver_tables import spread, table

# The reference answer lists price, status and customer; the order key picks how the prediction departs from it.
_PREDICTIONS_SQL = """
parts AS (SELECT *, o_totalprice::VARCHAR AS p, o_orderstatus AS s, o_custkey::VARCHAR AS c FROM orders),
predictions AS (SELECT o_orderkey AS example_id, (o_orderkey % 3)::VARCHAR AS checkpoint, CASE WHEN o_orderpriority < '3' THEN 'test'
    ELSE 'dev' END AS split, p || ', ' || s || ', ' || c AS ref, CASE o_orderkey % 6 WHEN 0 THEN p || ', ' || s || ', ' || c
    WHEN 1 THEN c || ', ' || s || ', ' || p WHEN 2 THEN p || ', ' || s || ', ' || c || '.0' WHEN 3 THEN p || ', ' || s
    WHEN 4 THEN ' ' || p || ', ' || lower(s) || ', ' || c || ' ' ELSE p || ', ' || s || ', ' || c || '1' END AS pred FROM parts),
spans AS (SELECT *, list_sort(list_transform(string_split(lower(trim(pred)), ', '), lambda x:
      coalesce('n' || TRY_CAST(x AS DOUBLE)::VARCHAR, 't' || trim(x)))) AS ps, list_sort(list_transform(
      string_split(lower(trim(ref)), ', '), lambda x: coalesce('n' || TRY_CAST(x AS DOUBLE)::VARCHAR, 't' || trim(x)))) AS rs,
    levenshtein(lower(trim(pred)), lower(trim(ref))) AS distance FROM predictions)
"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s, c = float_text(F.col("o_totalprice")), F.col("o_orderstatus"), F.col("o_custkey").cast("string")

    def joined(*parts) -> F.Column:
        return F.concat_ws(", ", *parts)

    forms = [joined(p, s, c), joined(c, s, p), F.concat(joined(p, s, c), F.lit(".0")), joined(p, s)]
    forms += [F.concat(F.lit(" "), joined(p, F.lower(s), c), F.lit(" ")), F.concat(joined(p, s, c), F.lit("1"))]
    columns = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus"]
    return spread(table(spark, sf_dir, "orders").select(*columns)).select(
        F.col("o_orderkey").alias("example_id"),
        (F.col("o_orderkey") % 3).cast("string").alias("checkpoint"),
        F.when(F.col("o_orderpriority") < "3", F.lit("test")).otherwise(F.lit("dev")).alias("split"),
        joined(p, s, c).alias("ref"),
        F.get(F.array(*forms), (F.col("o_orderkey") % 6).cast("int")).alias("pred"),
    )


@query(f"WITH {_PREDICTIONS_SQL} SELECT example_id, ps = rs AS is_correct FROM spans")
def denotation_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.denotation_match(predictions(spark, sf_dir)).select("example_id", "is_correct")


_SUMMARY = """count(*) AS samples, count(*) FILTER (ps = rs) / count(*) AS denotation_accuracy,
  sum(distance)::BIGINT / count(*) AS distance_mean,
  sqrt((count(*) * sum(distance * distance) - sum(distance) * sum(distance))::DOUBLE) / count(*) AS distance_std"""


@query(
    f"""WITH {_PREDICTIONS_SQL}, tally AS (SELECT distance, count(*) AS n FROM spans GROUP BY distance)
    SELECT 'all' AS run, {_SUMMARY}, (SELECT distance::INTEGER FROM tally ORDER BY n DESC, distance LIMIT 1) AS distance_mode FROM spans"""
)
def edit_distance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.summarize(predictions(spark, sf_dir).withColumn("run", F.lit("all")), ["run"])


@query(
    f"""WITH {_PREDICTIONS_SQL}, tally AS (SELECT checkpoint, split, distance, row_number() OVER (PARTITION BY checkpoint, split
      ORDER BY count(*) DESC, distance) AS r FROM spans GROUP BY checkpoint, split, distance),
    totals AS (SELECT checkpoint, split, {_SUMMARY} FROM spans GROUP BY checkpoint, split)
    SELECT totals.*, distance::INTEGER AS distance_mode
    FROM totals JOIN tally USING (checkpoint, split) WHERE r = 1"""
)
def checkpoint_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.summarize(predictions(spark, sf_dir), ["checkpoint", "split"])


@query(f"WITH {_PREDICTIONS_SQL} SELECT example_id, list_sort(list_distinct(ps)) = list_sort(list_distinct(rs)) AS strict FROM spans")
def strict_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = predictions(spark, sf_dir).select(
        "example_id", F.split(F.trim("ref"), ", ").alias("target"), F.split(F.trim("pred"), ", ").alias("pred")
    )
    return scoring.strict_match(listed).select("example_id", "strict")


@query(
    """SELECT o_orderkey AS example_id, [true, true, true, false, true, false, true][(o_orderkey % 7 + 1)::INT] AS flexible
    FROM orders"""
)
def flexible_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Target and prediction, by the order key: units, yes words, no words, yes against no, dates, two dates, equal words.
    c = F.col("o_custkey").cast("string")
    day = F.col("o_orderdate")
    pairs = [
        (F.concat(c, F.lit(" weeks")), F.concat(c, F.lit(".0 week"))),
        (F.lit("1"), F.lit("Yes")),
        (F.lit("no"), F.lit("FALSE")),
        (F.lit("no"), F.lit("yes")),
        (F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "yyyy-M-d")),
        (F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "yyyy-MM-'xx'")),
        (F.concat(F.lit("Customer "), c, F.lit(" (new)")), F.concat(F.lit('"customer  '), c, F.lit('"'))),
    ]
    way = (F.col("o_orderkey") % 7).cast("int")
    listed = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")).select(
        F.col("o_orderkey").alias("example_id"),
        F.array(F.get(F.array(*[t for t, _ in pairs]), way)).alias("target"),
        F.array(F.get(F.array(*[p for _, p in pairs]), way)).alias("pred"),
    )
    return scoring.flexible_match(listed).select("example_id", "flexible")


@query(f"WITH {_PREDICTIONS_SQL} SELECT example_id, 'pred: ' || pred || ' ref: ' || ref AS line FROM predictions")
def prediction_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = scoring.prediction_line(F.col("pred"), F.col("ref")).alias("line")
    return predictions(spark, sf_dir).select("example_id", line)


def _normal_sql() -> str:
    """Marks made plain, remarks cut from the end, quotes taken off, remarks cut again. No document ends in more than four remarks."""
    citations, brackets = r"(\[[^\]]*\]|[•♦†‡*#+])+$", r"( \([^)]*\))+$"
    strip = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
    cut = lambda x: strip(f"regexp_replace({strip(f"regexp_replace({x}, '{citations}', '')")}, '{brackets}', '')")
    plain = strip("""translate(strip_accents(text), '‘’´`“”‐‑‒–—−', '''''''''""------')""")
    steps = [f"SELECT doc_id, {plain} AS t FROM documents"] + [f"SELECT doc_id, {cut('t')} AS t FROM s{i}" for i in range(4)]
    steps += [rf"""SELECT doc_id, regexp_replace(t, '^"([^"]*)"$', '\1') AS t FROM s4"""] + [f"SELECT doc_id, {cut('t')} AS t FROM s{i}" for i in range(5, 9)]
    chain = ", ".join(f"s{i} AS ({step})" for i, step in enumerate(steps))
    return rf"WITH {chain} SELECT doc_id, {strip(r"lower(regexp_replace(regexp_replace(t, '\.$', ''), '\s+', ' ', 'g'))")} AS normal FROM s{len(steps) - 1}"


@query(_normal_sql())
def normalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select("doc_id", normalize_text("text").alias("normal"))


# One row of the table of common lengths for each letter of the prediction; a row is the running maximum of its candidates.
@query(
    f"""WITH RECURSIVE {_PREDICTIONS_SQL}, p AS (SELECT example_id, pred, ref, string_split(pred, '') AS a, string_split(ref, '') AS b FROM predictions),
    dp AS (SELECT example_id, 0 AS i, list_transform(b, lambda x: 0) AS known FROM p
      UNION ALL SELECT d.example_id, d.i + 1, list_transform(range(1, len(p.b) + 1), lambda j: list_max(list_transform(range(1, j + 1),
        lambda k: CASE WHEN p.a[d.i + 1] = p.b[k] THEN coalesce(d.known[k - 1], 0) + 1 ELSE d.known[k] END)))
      FROM dp d JOIN p USING (example_id) WHERE d.i < len(p.a))
    SELECT p.example_id, CASE WHEN pred = ref THEN 100 ELSE round_even(200 * d.known[-1] / (len(p.a) + len(p.b)), 0) END::INTEGER AS ratio
    FROM p JOIN dp d ON d.example_id = p.example_id AND d.i = len(p.a)"""
)
def fuzz_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).select("example_id", fuzz_ratio("pred", "ref").alias("ratio"))
