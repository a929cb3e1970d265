"""Tables as text, and the types found in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.corpus import lower_text_cells, raw_cells, to_cells, type_rows
from tablewright.operators import answers, linear
from tablewright.operators.relational import collapse_groups
from tablewright.operators.typing import apply_column_types, identify_cells, type_results, vote_column_types
from tablewright.queries import query
from tablewright.queries.shared_sql import ORDER_LINES, ORDER_SKETCHES, ORDER_TEXT_CELLS
from tablewright.skew import block_of, in_order
from tablewright.sources.driver_tables import (
    ORDER_COLUMNS,
    order_corpus,
    order_ids,
    order_lines,
    order_meta,
    order_rows,
    order_sketches,
    order_text_meta,
    order_text_rows,
    spread,
    table,
)

_LINE_TEXT = "l_partkey || ' | ' || l_quantity || ' | ' || l_extendedprice || ' | ' || l_discount || ' | ' || l_returnflag"


def linear_sql(header: str) -> str:
    return f"""
linear AS (
  SELECT o_orderkey AS table_id, 0::BIGINT AS segment, ' col : {header}' || coalesce(body, '') AS linear_text
  FROM (SELECT DISTINCT o_orderkey FROM orders) o LEFT JOIN (
    SELECT l_orderkey, string_agg(' row ' || row_pos || ' : ' || {_LINE_TEXT}, '' ORDER BY row_pos) AS body
    FROM order_lines GROUP BY l_orderkey) l ON l_orderkey = o_orderkey)
"""


HEADER = " | ".join(ORDER_COLUMNS)
NATURAL = ["part", "quantity", "price", "discount", "return flag"]


@query(f"WITH {ORDER_LINES}, {linear_sql(HEADER)} SELECT * FROM linear")
def linearize_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = order_corpus(spark, sf_dir)
    return linear.linearize(corpus.rows, corpus.meta)


@query(f"WITH {ORDER_LINES}, {linear_sql(' | '.join(NATURAL))} SELECT * FROM linear")
def swap_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = order_corpus(spark, sf_dir)
    natural = corpus.meta.withColumn("header", F.array(*map(F.lit, NATURAL)))
    return linear.linearize(corpus.rows, natural)


@query(
    f"""WITH {ORDER_LINES} SELECT l_orderkey AS table_id, row_pos, unnest([0, 1, 2, 3, 4]) AS col_pos,
      unnest([l_partkey::VARCHAR, l_quantity::VARCHAR, l_extendedprice::VARCHAR, l_discount::VARCHAR, l_returnflag]) AS raw,
      unnest(['int', 'float', 'float', 'float', 'text']) AS kind,
      unnest([l_partkey::DOUBLE, l_quantity, l_extendedprice, l_discount, NULL]) AS num,
      unnest([l_partkey::VARCHAR, l_quantity::VARCHAR, l_extendedprice::VARCHAR, l_discount::VARCHAR, l_returnflag]) AS value
    FROM order_lines"""
)
def delinearize_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, _ = linear.delinearize(linearize_tables(spark, sf_dir))
    return identify_cells(raw_cells(rows))


@query(
    """SELECT DISTINCT o_orderkey AS table_id, 'no rows' AS problem FROM orders
    WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"""
)
def unreadable_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linear.delinearize(linearize_tables(spark, sf_dir))[2]


def _order_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Votes do not depend on the row order, so the lines need no numbers here.
    lines = spread(table(spark, sf_dir, "lineitem")).withColumn("row_pos", F.lit(None).cast("long"))
    return vote_column_types(raw_cells(order_text_rows(lines)))


@query(
    f"""WITH {ORDER_TEXT_CELLS} SELECT table_id, col_pos, count(*) AS n_cells, count(TRY_CAST(raw AS DOUBLE)) AS n_numbers,
      count(*) FILTER (col_pos = 3) AS n_dates,
      CASE WHEN count(TRY_CAST(raw AS DOUBLE)) > 0 THEN 'number' WHEN col_pos = 3 THEN 'timestamp' ELSE 'text' END AS kind
    FROM text_cells GROUP BY table_id, col_pos"""
)
def column_type_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_votes(spark, sf_dir)


@query(
    f"""WITH {ORDER_TEXT_CELLS}, voted AS (SELECT *, CASE WHEN count(TRY_CAST(raw AS DOUBLE)) OVER (
        PARTITION BY table_id, col_pos) > 0 THEN 'number' WHEN col_pos = 3 THEN 'timestamp' ELSE 'text' END AS kind
      FROM text_cells)
    SELECT table_id, row_pos, col_pos, kind, CASE WHEN kind = 'number' THEN TRY_CAST(raw AS DOUBLE) END AS num,
      CASE WHEN kind = 'timestamp' THEN raw || ' 00:00:00' END AS at, CASE WHEN kind = 'text' THEN raw END AS "text"
    FROM voted"""
)
def columns_by_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_text_rows(order_lines(spark, sf_dir))
    cells = raw_cells(apply_column_types(rows, _order_votes(spark, sf_dir)))
    at = F.col("raw.at").cast("string").alias("at")
    return cells.select("table_id", "row_pos", "col_pos", "raw.kind", "raw.num", at, "raw.text")


@query(
    f"""WITH {ORDER_TEXT_CELLS} SELECT table_id, row_pos, col_pos,
      CASE WHEN col_pos = 4 THEN lower(raw) ELSE raw END AS raw,
      CASE WHEN col_pos < 3 THEN replace(raw, ',', '')::DOUBLE END AS num FROM text_cells"""
)
def typed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = order_text_meta(order_ids(spark, sf_dir).distinct())
    rows = type_rows(order_text_rows(order_lines(spark, sf_dir)), meta)
    return to_cells(lower_text_cells(rows, meta))


SKETCH_TEXT = """'SELECT ' || ['', 'MAX', 'MIN', 'COUNT', 'SUM', 'AVG'][agg + 1] || ' col' || sel || ' FROM table' ||
  CASE n_conds WHEN 0 THEN '' WHEN 1 THEN ' WHERE col4 = "A"'
  ELSE ' WHERE col4 = "A" AND col1 > "' || (10 + ex % 20) || '"' END"""


@query(f"WITH {ORDER_SKETCHES} SELECT ex AS example_id, {SKETCH_TEXT} AS query_text FROM sketches")
def sketch_sql_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = answers.sketch_sql_text(F.col("sel"), F.col("agg"), F.col("conds"))
    return order_sketches(spark, sf_dir).select("example_id", text.alias("query_text"))


@query(
    f"""WITH {ORDER_LINES}, {linear_sql(HEADER)}, {ORDER_SKETCHES}
    SELECT ex AS table_id, {SKETCH_TEXT} AS query_text, linear_text, true AS split_ok
    FROM sketches JOIN linear ON table_id = ex"""
)
def split_query_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = answers.sketch_sql_text(F.col("sel"), F.col("agg"), F.col("conds"))
    asked = order_sketches(spark, sf_dir).select("table_id", text.alias("asked"))
    return _split(asked.join(linearize_tables(spark, sf_dir), "table_id")).drop("segment")


def _split(segments: DataFrame) -> DataFrame:
    """The query stands before the first segment of its table."""
    opened = F.when(F.col("segment") == 0, F.concat("asked", "linear_text")).otherwise(F.col("linear_text"))
    questions = segments.select("table_id", "segment", opened.alias("question"))
    return linear.split_question(questions, segment="segment").drop("question")


@query(
    f"""WITH {ORDER_LINES}, {linear_sql(HEADER)}, {ORDER_SKETCHES}
    SELECT ex AS table_id, {SKETCH_TEXT} AS query_text, linear_text
    FROM sketches JOIN linear ON table_id = ex"""
)
def split_query_table_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Tables in segments of two rows, put together again after the split.
    text = answers.sketch_sql_text(F.col("sel"), F.col("agg"), F.col("conds"))
    asked = order_sketches(spark, sf_dir).select("table_id", text.alias("asked"))
    corpus = order_corpus(spark, sf_dir)
    split = _split(asked.join(linear.linearize(corpus.rows, corpus.meta, block_rows=2), "table_id"))
    piece = F.struct("segment", "linear_text")
    whole = split.groupBy("table_id").agg(F.max("query_text").alias("query_text"), F.sort_array(F.collect_list(piece)).alias("pieces"))
    return whole.select("table_id", "query_text", F.array_join("pieces.linear_text", "").alias("linear_text"))


@query(
    """WITH q AS (SELECT o_orderkey AS example_id, ['part key', 'quantity', 'extended price', 'ship date', 'return flag']
        [(o_orderkey % 5 + 1)::INT] AS name, o_orderstatus FROM orders),
      t AS (SELECT example_id, 'select ' || name || ' from w where return flag = ''' || o_orderstatus || ''' and ' || name ||
        ' not null ' AS query_text FROM q)
    SELECT example_id, replace(replace(replace(replace(replace(replace(query_text, ' extended price ', ' col_2 '),
      ' return flag ', ' col_4 '), ' ship date ', ' col_3 '), ' part key ', ' col_0 '), ' quantity ', ' col_1 '),
      ' not null', ' is not null') AS query_text FROM t"""
)
def rename_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    named = order_text_meta(orders.withColumn("table_id", F.col("o_orderkey"))).select("table_id", "header")
    asked = orders.select(F.col("o_orderkey").alias("table_id"), "o_orderstatus").join(named, "table_id")
    name = F.get("header", (F.col("table_id") % 5).cast("int"))
    text = F.concat(
        F.lit("select "), name, F.lit(" from w where return flag = '"), "o_orderstatus", F.lit("' and "), name, F.lit(" not null")
    )
    written = asked.select("table_id", "header", text.alias("written"))
    return written.select(
        F.col("table_id").alias("example_id"), linear.rename_headers(F.col("written"), F.col("header")).alias("query_text")
    )


@query(
    """SELECT o_orderkey AS example_id, 'select ' || lower(o_orderstatus) || ' from w where c2 > ' || o_custkey AS query_text
    FROM orders"""
)
def token_query_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    def token(kind: str, word) -> F.Column:
        return F.array(F.lit(kind), word)

    words = [("Keyword", F.lit("select")), ("Column", F.lower("o_orderstatus")), ("Keyword", F.lit("from"))]
    words += [("Keyword", F.lit("w")), ("Keyword", F.lit("where")), ("Column", F.lit("c2")), ("Keyword", F.lit(">"))]
    words += [("Literal.Number", F.col("o_custkey").cast("string"))]
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.array(*[token(*w) for w in words]).alias("sql"))
    return orders.select(F.col("o_orderkey").alias("example_id"), linear.token_query_text(F.col("sql")).alias("query_text"))


@query(
    f"""WITH {ORDER_SKETCHES} SELECT ex AS example_id, (o_orderstatus <> 'P') AS same
    FROM sketches JOIN orders ON o_orderkey = ex"""
)
def sketch_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The other sketch has its conditions reversed and their text in the other case; some select another column.
    status = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("example_id"), "o_orderstatus")
    other = F.transform(
        F.reverse("conds"),
        lambda c: F.struct(c["col"].alias("col"), c["op"].alias("op"), F.lower(c["value"]).alias("value")),
    )
    other_sel = F.when(F.col("o_orderstatus") == "P", F.col("sel") + 1).otherwise(F.col("sel"))
    same = answers.same_sketch(F.col("sel"), F.col("agg"), F.col("conds"), other_sel, F.col("agg"), other)
    return order_sketches(spark, sf_dir).join(status, "example_id").select("example_id", same.alias("same"))


@query(
    """WITH r AS (SELECT o_orderkey AS example_id, o_custkey AS c, o_orderkey % 7 AS way FROM orders)
    SELECT example_id,
      CASE way WHEN 0 THEN c || '| ' || (c + 1) WHEN 1 THEN c || '.5| 2' WHEN 2 THEN 't| none| f' WHEN 3 THEN c || ',, 2.0| 3'
        WHEN 4 THEN 'a' || c || ',, b| none' WHEN 5 THEN '' ELSE 'x' || c || '| none' END AS result_text,
      ['int', 'float', 'bool', 'number_list', 'list', 'empty', 'text'][(way + 1)::INT] AS kind,
      CASE way WHEN 0 THEN c || '/' || (c + 1) WHEN 1 THEN c || '.5/2.0' WHEN 2 THEN 't/missing/f' WHEN 3 THEN c || '.0;2.0/3.0'
        WHEN 4 THEN 'a' || c || ';b/missing' WHEN 5 THEN '' ELSE 'x' || c || '/missing' END AS entries
    FROM r"""
)
def result_typing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_custkey").cast("string")
    forms = [
        F.concat(c, F.lit("| "), (F.col("o_custkey") + 1).cast("string")),
        F.concat(c, F.lit(".5| 2")),
        F.lit("t| none| f"),
        F.concat(c, F.lit(",, 2.0| 3")),
        F.concat(F.lit("a"), c, F.lit(",, b| none")),
        F.lit(""),
        F.concat(F.lit("x"), c, F.lit("| none")),
    ]
    text = F.get(F.array(*forms), (F.col("o_orderkey") % 7).cast("int"))
    results = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("example_id"), text.alias("result_text"))
    shown = F.array_join(F.transform("entries", lambda e: F.array_join(e, ";")), "/", "missing")
    return type_results(results).withColumn("entries", shown)


@query(
    f"""WITH {ORDER_LINES} SELECT l_orderkey AS table_id, 0::BIGINT AS segment,
      string_agg(l_quantity::BIGINT::VARCHAR, '| ' ORDER BY row_pos) AS whole_numbers,
      CASE WHEN bool_and(l_discount = floor(l_discount)) THEN string_agg(l_discount::BIGINT::VARCHAR, '| ' ORDER BY row_pos)
        ELSE string_agg(l_discount::VARCHAR, '| ' ORDER BY row_pos) END AS numbers,
      string_agg(lower(l_returnflag), '| ' ORDER BY row_pos) AS texts,
      string_agg(CASE WHEN l_linestatus = 'O' THEN 't' ELSE 'f' END, '| ' ORDER BY row_pos) AS flags,
      string_agg(lower(l_returnflag || ',, ' || l_linestatus), '| ' ORDER BY row_pos) AS lists
    FROM order_lines GROUP BY l_orderkey"""
)
def answer_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer_text(order_lines(spark, sf_dir).withColumn("segment", block_of(F.col("row_pos"))))


@query(
    f"""WITH {ORDER_LINES}, w AS (SELECT *, bool_and(l_discount = floor(l_discount)) OVER (PARTITION BY l_orderkey) AS whole FROM order_lines)
    SELECT l_orderkey AS table_id, (row_pos - 1) // 2 AS segment, string_agg(l_quantity::BIGINT::VARCHAR, '| ' ORDER BY row_pos) AS whole_numbers,
      string_agg(CASE WHEN whole THEN l_discount::BIGINT::VARCHAR ELSE l_discount::VARCHAR END, '| ' ORDER BY row_pos) AS numbers,
      string_agg(lower(l_returnflag), '| ' ORDER BY row_pos) AS texts,
      string_agg(CASE WHEN l_linestatus = 'O' THEN 't' ELSE 'f' END, '| ' ORDER BY row_pos) AS flags,
      string_agg(lower(l_returnflag || ',, ' || l_linestatus), '| ' ORDER BY row_pos) AS lists
    FROM w GROUP BY l_orderkey, (row_pos - 1) // 2"""
)
def answer_text_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Segments of two rows: the form of a number is that of the whole answer.
    return _answer_text(order_lines(spark, sf_dir).withColumn("segment", block_of(F.col("row_pos"), 2)))


def _answer_text(lines: DataFrame) -> DataFrame:
    entry = F.struct("row_pos", "l_quantity", "l_discount", "l_returnflag", "l_linestatus")
    listed = lines.groupBy(F.col("l_orderkey").alias("table_id"), "segment").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    # One row for each segment of an answer meets here, not its rows.
    answer = W.partitionBy("table_id")
    whole = {c: F.bool_and(answers.all_whole(F.col(f"e.{c}"))).over(answer) for c in ("l_quantity", "l_discount")}
    listed = listed.withColumns({f"{c}_whole": flag for c, flag in whole.items()})
    return listed.select(
        "table_id",
        "segment",
        answers.numbers_text(F.col("e.l_quantity"), F.col("l_quantity_whole")).alias("whole_numbers"),
        answers.numbers_text(F.col("e.l_discount"), F.col("l_discount_whole")).alias("numbers"),
        answers.texts_text(F.col("e.l_returnflag")).alias("texts"),
        answers.booleans_text(F.transform("e", lambda x: x["l_linestatus"] == "O")).alias("flags"),
        answers.lists_text(F.transform("e", lambda x: F.array(x["l_returnflag"], x["l_linestatus"]))).alias("lists"),
    )


@query(
    f"""WITH {ORDER_LINES}, c AS (SELECT *, count(DISTINCT l_returnflag) OVER (PARTITION BY l_orderkey) AS n FROM order_lines)
    SELECT l_orderkey AS table_id, row_pos, l_returnflag AS answer FROM c WHERE n > 1 OR row_pos = 1"""
)
def answer_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = order_lines(spark, sf_dir).select(F.col("l_orderkey").alias("table_id"), "row_pos", F.col("l_returnflag").alias("answer"))
    return collapse_groups(lines, ["table_id"], "answer", "row_pos")
