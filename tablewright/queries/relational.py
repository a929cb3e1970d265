"""Operators on the driver's tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.numbers import exact_sum, float_text, julian_day
from tablewright.operators import answers
from tablewright.operators import relational as rel
from tablewright.queries import query
from tablewright.skew import ensure_checkpoint_dir
from tablewright.sources.driver_tables import LINE_ORDER, table

_ORDER_KEY_TIES = ["o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_retailprice >= 905.5 AND p_size <> 7 AND p_partkey % 11 <> 3")
def filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Some rows are marked as totals.
    marked = table(spark, sf_dir, "part").withColumn("agg", F.when(F.col("p_partkey") % 11 == 3, F.lit(2.0)).otherwise(F.lit(0.0)))
    chosen = marked.where((F.col("p_retailprice") >= 905.5) & rel.differs(F.col("p_size"), 7))
    return rel.project(chosen, "p_partkey", "p_name", "p_retailprice")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IS NULL OR (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') OR (o_totalprice > 400000 AND o_orderpriority <> '5-LOW')")
def nested_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    urgent = (status == "F") & (priority == "1-URGENT")
    dear = (F.col("o_totalprice") > 400000) & rel.differs(priority, "5-LOW")
    return table(spark, sf_dir, "orders").where(status.isNull() | urgent | dear).select("o_orderkey")


@query("SELECT c_custkey, c_mktsegment IN ('BUILDING', 'MACHINERY') AS is_member FROM customer")
def in_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    member = rel.is_in(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"])
    return table(spark, sf_dir, "customer").select("c_custkey", member.alias("is_member"))


@query(
    """SELECT o_orderkey, NULLIF(o_orderstatus, 'P') IS NULL AS is_missing FROM orders
    WHERE NULLIF(o_orderpriority, '5-LOW') IS NOT NULL"""
)
def null_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    status = F.nullif(F.col("o_orderstatus"), F.lit("P"))
    priority = F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))
    return orders.where(priority.isNotNull()).select("o_orderkey", status.isNull().alias("is_missing"))


@query("SELECT o_orderkey, NULLIF(o_orderstatus, 'P') AS status FROM orders WHERE o_orderstatus = 'P'")
def none_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    # No status reads "none", so the literal asks for the missing ones.
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"))
    return rel.equals_literal(orders, "status", "none")


@query(
    """SELECT o_orderkey, v, coalesce(TRY_CAST(v AS DOUBLE) > 250000, false) AS above
    FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE o_totalprice::VARCHAR END AS v FROM orders)"""
)
def text_number_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("o_orderstatus") == "O", F.lit("open")).otherwise(float_text(F.col("o_totalprice")))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("v"))
    return orders.withColumn("above", rel.text_compare(F.col("v"), ">", 250000))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_discount > l_tax")
def column_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.where(F.col("l_discount") > F.col("l_tax")).select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    """SELECT o_orderkey, o_totalprice FROM orders
    WHERE o_totalprice >= (SELECT avg(o_totalprice) FROM orders WHERE o_orderstatus = 'F')
      AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"""
)
def scalar_subquery_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    mean = orders.where("o_orderstatus = 'F'").agg(F.avg("o_totalprice").alias("mean")).scalar()
    buyers = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return orders.where(F.col("o_totalprice") >= mean).join(buyers, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


def _block_lists_sql(keys: str) -> str:
    return f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY o_orderkey, o_totalprice, o_orderdate,
        o_orderpriority) AS pos FROM orders),
      v AS (SELECT *, CASE WHEN o_orderstatus = 'P' THEN 'missing' ELSE o_totalprice::VARCHAR END AS v FROM n)
      SELECT {{key}}, (pos - 1) // 4096 AS block, count(*) AS size, string_agg(v, '/' ORDER BY pos) AS "values"
      FROM v GROUP BY {keys}, (pos - 1) // 4096"""


def _shown_lists(lists: DataFrame) -> DataFrame:
    shown = F.array_join(F.transform("values", float_text), "/", "missing")
    return lists.withColumn("size", F.size("values").cast("long")).withColumn("values", shown)


@query(_block_lists_sql("o_custkey").format(key="o_custkey"))
def group_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    orders = table(spark, sf_dir, "orders").withColumn("price", price)
    return _shown_lists(rel.group_lists(orders, ["o_custkey"], "price", _ORDER_KEY_TIES))


@query(_block_lists_sql("o_orderstatus, o_orderpriority").format(key="o_orderstatus || '/' || o_orderpriority AS key"))
def nested_group_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    orders = table(spark, sf_dir, "orders").withColumn("price", price)
    orders = orders.withColumn("key", F.array("o_orderstatus", "o_orderpriority"))
    lists = rel.group_lists(orders, ["key"], "price", _ORDER_KEY_TIES)
    return _shown_lists(lists).withColumn("key", F.array_join("key", "/"))


@query(
    """SELECT l_orderkey, bool_or(l_returnflag = 'A') AS any_equal, bool_or(l_returnflag <> 'A') AS any_differs,
      bool_and(l_quantity > 5) AS all_above, bool_and(l_quantity <= 40) AS all_at_most,
      bool_or(l_returnflag IN ('N', 'R')) AS any_in FROM lineitem GROUP BY l_orderkey"""
)
def grouped_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, quantity = F.col("l_returnflag"), F.col("l_quantity")
    return rel.group_verdicts(
        table(spark, sf_dir, "lineitem"),
        ["l_orderkey"],
        any_equal=rel.any_row(flag == "A"),
        any_differs=rel.any_row(~flag.eqNullSafe(F.lit("A"))),
        all_above=rel.all_rows(quantity > 5),
        all_at_most=rel.all_rows(quantity <= 40),
        any_in=rel.any_row(rel.is_in(flag, ["N", "R"])),
    )


def _list_sql(key: str) -> str:
    return f"""SELECT {key}, list_contains(list(l_linestatus), 'F') AS any_equal,
      len(list_filter(list(l_linestatus), lambda x: x <> 'F')) > 0 AS any_differs,
      len(list_filter(list(l_quantity), lambda x: NOT x > 5)) = 0 AS all_above, bool_and(l_quantity > 0) AS all_positive,
      len(list_filter(list(l_linestatus), lambda x: x IN ('O', 'R'))) > 0 AS any_in,
      len(list_distinct(list(l_quantity))) AS n_distinct, max(l_quantity) AS greatest, min(l_quantity) AS least
    FROM lineitem GROUP BY {key}"""


def _list_verdicts(spark: SparkSession, sf_dir: str, key: str, **size: int) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("pair", F.struct("l_linestatus", "l_quantity"))
    blocks = rel.group_lists(lines, [key], "pair", ["l_orderkey", *LINE_ORDER], **size)
    flags, quantities = F.col("values.l_linestatus"), F.col("values.l_quantity")
    verdicts = rel.list_verdicts(
        blocks,
        [key],
        any_of={"any_equal": rel.any_equal(flags, "F"), "any_differs": rel.any_differs(flags, "F"), "any_in": rel.any_in(flags, ["O", "R"])},
        all_of={"all_above": rel.all_compare(quantities, ">", 5), "all_positive": rel.all_compare(quantities, ">", 0)},
        greatest={"greatest": F.array_max(quantities)},
        least={"least": F.array_min(quantities)},
    )
    return verdicts.join(rel.list_distinct_count(blocks, [key], quantities), key)


@query(_list_sql("l_orderkey"))
def list_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _list_verdicts(spark, sf_dir, "l_orderkey")


@query(_list_sql("l_returnflag"))
def list_compare_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Three groups of many blocks each.
    return _list_verdicts(spark, sf_dir, "l_returnflag", block_rows=64)


@query(
    """SELECT o_custkey, max(v) AS greatest, min(v) AS least, coalesce(sum(v::DECIMAL(28,6))::DOUBLE, 0) AS total,
      sum(v::DECIMAL(28,6))::DOUBLE / count(v) AS mean, count(v) AS n_values, count(*) AS n_rows
    FROM (SELECT o_custkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS v FROM orders) GROUP BY o_custkey"""
)
def group_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    price = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("v")
    return table(spark, sf_dir, "orders").select("o_custkey", price).groupBy("o_custkey").agg(
        F.max(v).alias("greatest"),
        F.min(v).alias("least"),
        F.coalesce(exact_sum(v), F.lit(0.0)).alias("total"),
        F.try_divide(exact_sum(v), F.count(v)).alias("mean"),
        F.count(v).alias("n_values"),
        F.count("*").alias("n_rows"),
    )


@query(
    """SELECT o_custkey, count(*) AS n, max(o_totalprice) - min(o_totalprice) AS spread FROM orders GROUP BY o_custkey
    HAVING (max(o_totalprice) - min(o_totalprice) > 300000 AND count(*) >= 5) OR count(*) = 1"""
)
def having_arith(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = (F.max("o_totalprice") - F.min("o_totalprice")).alias("spread")
    groups = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), spread)
    wide = (F.col("spread") > 300000) & (F.col("n") >= 5)
    return rel.having(groups, wide, F.col("n") == 1, either=True)


@query(
    """SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey DESC, o_orderdate DESC) AS rank, o_orderkey, o_totalprice
    FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC, o_orderdate DESC LIMIT 100)"""
)
def order_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = rel.top_rows(table(spark, sf_dir, "orders"), 100, ["-o_totalprice", "-o_orderkey", "-o_orderdate"])
    return top.select("rank", "o_orderkey", "o_totalprice")


@query(
    """SELECT row_number() OVER (ORDER BY abs(o_totalprice - 250000), o_orderkey) AS rank, o_orderkey FROM orders
    WHERE o_orderstatus <> 'P'"""
)
def order_by_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    distance = F.when(F.col("o_orderstatus") != "P", F.abs(F.col("o_totalprice") - 250000))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", distance.alias("distance"))
    return rel.ordered(orders, "o_orderkey", "distance", ["o_orderkey"]).select("rank", "o_orderkey")


@query(
    """SELECT l_orderkey, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC,
      l_extendedprice DESC, l_partkey DESC, l_suppkey DESC) AS rank FROM lineitem"""
)
def order_in_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    ties = ["l_extendedprice", "l_partkey", "l_suppkey"]
    ranked = rel.ordered(lines, "l_partkey", "l_quantity", ties, ["l_orderkey"], descending=True)
    return ranked.select("l_orderkey", "l_partkey", "l_extendedprice", "rank")


@query(
    """SELECT * FROM (SELECT l_orderkey, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey
      ORDER BY l_extendedprice DESC, l_partkey, l_suppkey) AS rank FROM lineitem) WHERE rank <= 2"""
)
def topk_per_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")
    return rel.top_per_group(lines, ["l_orderkey"], 2, ["-l_extendedprice", "l_partkey", "l_suppkey"]).drop("l_suppkey")


@query(
    """WITH g AS (SELECT o_custkey, row_number() OVER (ORDER BY max(o_totalprice) DESC, o_custkey) AS group_rank
      FROM orders GROUP BY o_custkey)
    SELECT group_rank, o_custkey, o_orderkey FROM orders JOIN g USING (o_custkey)"""
)
def order_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return rel.order_groups(orders, ["o_custkey"], F.max("o_totalprice"), descending=True).drop("o_totalprice")


@query(
    """SELECT o_orderkey, [o_orderstatus, o_orderpriority, 'x'] AS joined, [o_orderpriority, o_orderpriority] AS common,
      [o_orderstatus] AS same, [o_orderstatus, NULL] AS mixed FROM orders"""
)
def list_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, priority, missing = F.col("o_orderstatus"), F.col("o_orderpriority"), F.lit(None).cast("string")
    left, right = F.array(status, priority, status, priority), F.array(priority, F.lit("x"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        rel.list_union(left, right).alias("joined"),
        rel.list_intersect(left, right).alias("common"),
        answers.collapse_answers(F.array(status, status)).alias("same"),
        answers.collapse_answers(F.array(status, missing)).alias("mixed"),
    )


@query(
    """SELECT o_orderkey, o_totalprice + o_custkey AS plus, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice - o_custkey END AS minus,
      o_totalprice / NULLIF(o_orderkey % 3, 0) AS quotient FROM orders"""
)
def text_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    price, customer = F.col("o_totalprice").cast("string"), F.col("o_custkey").cast("string")
    spoiled = F.when(key % 5 == 0, F.concat(customer, F.lit(" units"))).otherwise(customer)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        rel.text_arithmetic(price, "+", customer).alias("plus"),
        rel.text_arithmetic(price, "-", spoiled).alias("minus"),
        rel.text_arithmetic(price, "/", (key % 3).cast("string")).alias("quotient"),
    )


@query("SELECT o_orderstatus, coalesce(sum(o_custkey) FILTER (o_orderkey % 5 <> 0), 0)::DOUBLE AS total FROM orders GROUP BY o_orderstatus")
def text_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = F.col("o_custkey").cast("string")
    spoiled = F.when(F.col("o_orderkey") % 5 == 0, F.concat(customer, F.lit(" units"))).otherwise(customer)
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(rel.text_total(spoiled).alias("total"))


@query(
    """SELECT s_suppkey, abs(s_acctbal - (SELECT min(c_acctbal) FROM customer)) AS distance,
      (SELECT max(c_acctbal) FROM customer) - (SELECT max(s_acctbal) FROM supplier) AS gap FROM supplier"""
)
def abs_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, suppliers = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    least = rel.one_value(customers, F.min("c_acctbal"))
    gap = rel.one_value(customers, F.max("c_acctbal")) - rel.one_value(suppliers, F.max("s_acctbal"))
    return suppliers.select("s_suppkey", F.abs(F.col("s_acctbal") - least).alias("distance"), gap.alias("gap"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity + l_tax AS plus, l_quantity - 3 AS minus, 100 / l_quantity AS share,
      l_extendedprice / NULLIF(l_discount, 0) AS quotient, (l_quantity - l_linenumber) - 3 > 0 AS above FROM lineitem"""
)
def column_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    quantity = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        (quantity + F.col("l_tax")).alias("plus"),
        (quantity - 3).alias("minus"),
        rel.divide(F.lit(100), quantity).alias("share"),
        rel.divide(F.col("l_extendedprice"), F.col("l_discount")).alias("quotient"),
        ((quantity - F.col("l_linenumber")) - 3 > 0).alias("above"),
    )


@query("SELECT count(*) AS n FROM (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 10)")
def count_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return rel.having(groups, F.col("n") > 10).agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY l_returnflag")
def count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey").distinct()
    return lines.groupBy("l_returnflag").agg(F.count("l_partkey").alias("n_parts"))


@query(
    """SELECT l_returnflag, count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_exact, true AS is_close FROM lineitem GROUP BY l_returnflag"""
)
def distinct_by_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Sketches of months, kept as a table and merged; the estimate has to lie within four standard errors of the exact count.
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", F.date_trunc("month", "l_shipdate").alias("month"), "l_orderkey")
    folder = os.path.join(ensure_checkpoint_dir(spark), f"sketches-{uuid.uuid4().hex}")
    rel.distinct_sketches(lines, ["l_returnflag", "month"], "l_orderkey").write.parquet(folder)
    merged = rel.merge_distinct(spark.read.parquet(folder), ["l_returnflag"])
    exact = lines.select("l_returnflag", "l_orderkey").distinct().groupBy("l_returnflag").agg(F.count("l_orderkey").alias("n_exact"))
    error = 4 * 1.04 / 2 ** (rel.SKETCH_BITS / 2)
    close = F.abs(F.col("n_distinct") - F.col("n_exact")) <= error * F.col("n_exact")
    return merged.join(exact, "l_returnflag").select("l_returnflag", "n_rows", "n_exact", close.alias("is_close"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN julian(o_orderdate) - 0.5 END AS day FROM orders"""
)
def julian_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.lit("unknown"))
    dated = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("d"))
    return dated.select("o_orderkey", julian_day(F.col("d")).alias("day"))


@query("SELECT doc_id, length(text)::INTEGER AS n FROM documents")
def text_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"))


@query("SELECT s_nationkey AS nation FROM supplier UNION SELECT c_nationkey FROM customer WHERE c_acctbal < 0")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))
    customers = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("nation"))
    return rel.union_distinct(suppliers, customers)


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
    WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25)"""
)
def bag_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    parts = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    return rel.bag_intersect(lines, parts, "l_partkey")


@query(
    """(SELECT doc_id FROM documents WHERE lang = 'en' UNION SELECT doc_id FROM documents WHERE source < 'src15')
    EXCEPT (SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM documents WHERE n_chars > 2000)"""
)
def except_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    kept = [documents.where("lang = 'en'").select("doc_id"), documents.where("source < 'src15'").select("doc_id")]
    gone = [labels.where("toxic = 1").select("doc_id"), documents.where("n_chars > 2000").select("doc_id")]
    return rel.except_ids(kept, gone)
