"""Corpora derived from the driver's tables: orders as small tables, and queries about them."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.corpus import Corpus
from tablewright.functions.numbers import float_text
from tablewright.skew import HOT_ROWS, has_larger_group, row_positions

# Columns of the order tables, by position.
ORDER_COLUMNS = ["l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag"]
ORDER_TYPES = ["real", "real", "real", "real", "text"]
# (order, line number) repeats in the data, so every column takes part in the row order.
LINE_ORDER = [
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_shipdate",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
]


# Orders below this total price have no plan document: about one in fifty.
SMALLEST_PLANNED = 10000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# Heavy work inside rows is done for about as many rows in a task; only their number of tasks grows with a table.
ROWS_PER_TASK = 100_000


def spread(scanned: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Deal the rows of a scan out to tasks of a bounded number of rows, and to every core at least.

    Only worth it before heavy work inside rows: the pieces of a scan go by the bytes of its files, and a file of few
    bytes may hold very many rows. The rows are counted from what the files say of themselves.
    """
    cores = scanned.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, -(-scanned.count() // rows_per_task))
    return scanned if scanned.rdd.getNumPartitions() >= tasks else scanned.repartition(tasks)


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines numbered inside their order: the rows of one small table per order."""
    return row_positions(table(spark, sf_dir, "lineitem"), ["l_orderkey"], LINE_ORDER)


def _cell(raw: Column, number: Column) -> Column:
    return F.struct(raw.alias("raw"), number.alias("num"))


def order_rows(lines: DataFrame) -> DataFrame:
    numeric = [_cell(F.col("l_partkey").cast("string"), F.col("l_partkey").cast("double"))]
    numeric += [_cell(float_text(F.col(c)), F.col(c)) for c in ORDER_COLUMNS[1:4]]
    flag = _cell(F.col("l_returnflag"), F.lit(None).cast("double"))
    return lines.select(
        F.col("l_orderkey").alias("table_id"), "row_pos", F.array(*numeric, flag).alias("cells")
    )


def order_meta(tables: DataFrame) -> DataFrame:
    """Every order table has the same columns."""
    return tables.select(
        "table_id",
        F.array(*map(F.lit, ORDER_COLUMNS)).alias("header"),
        F.array(*map(F.lit, ORDER_TYPES)).alias("types"),
    )


def order_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """Orders with their lines as tables. Orders without lines are tables without rows."""
    tables = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("table_id"))
    lines = table(spark, sf_dir, "lineitem")
    hot = has_larger_group(lines, ["l_orderkey"], HOT_ROWS)
    return Corpus(order_rows(row_positions(lines, ["l_orderkey"], LINE_ORDER, hot=hot)), order_meta(tables), hot)


def order_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per order. The order key picks the column, the aggregate and the conditions."""
    key = F.col("o_orderkey")
    sel = F.element_at(F.array(*map(F.lit, [1, 2, 4, 3])), (key % 4 + 1).cast("int"))
    turn = F.floor(key / 4)
    text_agg = F.element_at(F.array(*map(F.lit, [0, 3, 1, 2])), (turn % 4 + 1).cast("int"))

    def cond(col: int, op: int, value: Column) -> Column:
        return F.struct(F.lit(col).alias("col"), F.lit(op).alias("op"), value.cast("string").alias("value"))

    by_flag, by_quantity = cond(4, 0, F.lit("A")), cond(1, 1, 10 + key % 20)
    no_conds = F.array().cast("array<struct<col:int,op:int,value:string>>")
    conds = F.when(key % 3 == 0, no_conds).when(key % 3 == 1, F.array(by_flag)).otherwise(F.array(by_flag, by_quantity))
    return table(spark, sf_dir, "orders").select(
        key.alias("example_id"),
        key.alias("table_id"),
        sel.alias("sel"),
        F.when(sel == 4, text_agg).otherwise((turn % 6).cast("int")).alias("agg"),
        conds.alias("conds"),
    )


def order_text_rows(lines: DataFrame) -> DataFrame:
    """Order lines as raw text cells: numbers, numbers with thousands marks, dates and words."""
    cells = F.array(
        F.col("l_partkey").cast("string"),
        float_text(F.col("l_quantity")),
        F.format_number("l_extendedprice", 2),
        F.date_format("l_shipdate", "yyyy-MM-dd"),
        F.col("l_returnflag"),
    )
    return lines.select(F.col("l_orderkey").alias("table_id"), "row_pos", cells.alias("cells"))


def order_text_meta(tables: DataFrame) -> DataFrame:
    names = ["part key", "quantity", "extended price", "ship date", "return flag"]
    types = ["real", "real", "real", "text", "text"]
    return tables.select(
        "table_id", F.array(*map(F.lit, names)).alias("header"), F.array(*map(F.lit, types)).alias("types")
    )


def order_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("table_id"))


def order_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One plan document per order: a limit over a sort over one scan, or two for even keys. The smallest orders have none."""
    price, customer = float_text(F.col("o_totalprice")), F.col("o_custkey").cast("string")
    second_scan = F.when(
        F.col("o_orderkey") % 2 == 0,
        F.lit("<Plan><Node-Type>Index Scan</Node-Type><Index-Name><![CDATA[by <key>]]></Index-Name><Heap-Fetches>3</Heap-Fetches></Plan>"),
    ).otherwise(F.lit(""))
    xml = F.concat(
        F.lit('<?xml version="1.0"?>\n<explain xmlns="http://www.postgresql.org/2009/explain"><Query>\n<Plan>'),
        F.lit("<Node-Type>Limit</Node-Type><Parallel-Aware>false</Parallel-Aware><Startup-Cost>1.5</Startup-Cost>\n"),
        F.lit("<Plans><Plan><Node-Type>Sort</Node-Type><Parent-Relationship>Outer</Parent-Relationship>"),
        F.lit("<Sort-Key><Item>o_custkey</Item><Item>"),
        F.col("o_orderpriority"),
        F.lit(" DESC</Item></Sort-Key><!-- sorted --><Plans><Plan><Node-Type> Seq Scan </Node-Type><Relation-Name>w</Relation-Name>"),
        F.lit("<Filter>((p &lt; "),
        price,
        F.lit(") AND (c &gt; "),
        customer,
        F.lit("))</Filter><Alias/></Plan>"),
        second_scan,
        F.lit("</Plans></Plan></Plans></Plan><Planning-Time>0.1</Planning-Time><Triggers><Trigger/></Triggers></Query></explain>"),
    )
    columns = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus"]
    return spread(table(spark, sf_dir, "orders").select(*columns)).select(
        F.col("o_orderkey").alias("plan_id"), F.when(F.col("o_totalprice") >= SMALLEST_PLANNED, xml).alias("xml_plan")
    )


def geo_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region to nation to customer to order, and a shortcut from region to customer: one graph per region."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("graph_id"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(nation, "n_nationkey")
    order = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))

    def node(kind: str, key: str) -> Column:
        return F.concat(F.lit(kind), F.col(key).cast("string"))

    pairs = [
        nation.select("graph_id", node("r", "graph_id").alias("src"), node("n", "n_nationkey").alias("dst")),
        customer.select("graph_id", node("n", "n_nationkey").alias("src"), node("c", "c_custkey").alias("dst")),
        customer.select("graph_id", node("r", "graph_id").alias("src"), node("c", "c_custkey").alias("dst")),
        order.join(customer, "c_custkey").select("graph_id", node("c", "c_custkey").alias("src"), node("o", "o_orderkey").alias("dst")),
    ]
    edges = pairs[0]
    for more in pairs[1:]:
        edges = edges.unionByName(more)
    return edges
