"""Plan documents of orders and the graphs between regions, nations, customers and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators.linear import linearize
from tablewright.plans import dags, shred
from tablewright.plans.reader import register_plan_nodes
from tablewright.queries import query
from tablewright.queries.shared_sql import ORDER_LINES
from tablewright.sources.driver_tables import geo_edges, order_corpus, order_plans, spread, table

_NODES_SQL = """
nodes AS (
  SELECT o_orderkey AS plan_id, 0 AS node_id, NULL::INTEGER AS parent_id, 'Limit' AS node_type, 0 AS width, 0 AS depth, '' AS attrs FROM planned
  UNION ALL SELECT o_orderkey, 1, 0, 'Sort', 0, 1, 'Sort-Key_Item : o_custkey|Sort-Key_Item : ' || o_orderpriority || ' DESC' FROM planned
  UNION ALL SELECT o_orderkey, 2, 1, 'Seq Scan', 0, 2, 'Relation-Name : w|Filter : ((p < ' || o_totalprice || ') AND (c > ' ||
    o_custkey || '))|Alias : ' FROM planned
  UNION ALL SELECT o_orderkey, 3, 1, 'Index Scan', 1, 2, 'Index-Name : by <key>' FROM planned WHERE o_orderkey % 2 = 0)
"""
_PLANNED = f"planned AS (SELECT * FROM orders WHERE o_totalprice >= 10000), {_NODES_SQL}"


def _shown(nodes: DataFrame) -> DataFrame:
    pairs = F.transform("attrs", lambda a: F.concat(a["key"], F.lit(" : "), a["value"]))
    return nodes.withColumn("attrs", F.array_join(pairs, "|"))


@query(f"WITH {_PLANNED} SELECT * FROM nodes")
def plan_shred(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = shred.shred_plans(order_plans(spark, sf_dir), on_missing="drop")
    return _shown(shred.explode_nodes(plans, "plan_id"))


@query(f"WITH {_PLANNED} SELECT node_type, depth, count(*) AS n, count(DISTINCT attrs) AS n_attrs, max(plan_id) AS last_plan FROM nodes GROUP BY node_type, depth")
def plan_nodes_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The table function in a query that is written in SQL.
    register_plan_nodes(spark, shred.IGNORED_TAGS)
    return spark.sql(
        """SELECT n.node_type, n.depth, count(*) AS n, count(DISTINCT concat_ws('|', transform(n.attrs, a -> concat(a.key, ' : ', a.value)))) AS n_attrs,
          max(p.plan_id) AS last_plan
        FROM {plans} p, LATERAL plan_nodes(p.xml_plan) n GROUP BY n.node_type, n.depth""",
        plans=order_plans(spark, sf_dir),
    )


@query(f"WITH {_PLANNED} SELECT plan_id, node_id, 2 - depth AS depth FROM nodes")
def plan_depth_reflect(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = shred.reflect_depth(shred.shred_plans(order_plans(spark, sf_dir), on_missing="drop"))
    return shred.explode_nodes(plans, "plan_id").select("plan_id", "node_id", "depth")


LINEARIZED_PLANS = f"""{_PLANNED}, written AS (SELECT plan_id, depth, width, node_id, ' NODE ' || node_type || '|' || width || '|' || (2 - depth) || '|' ||
        CASE node_id WHEN 0 THEN 'Query' WHEN 1 THEN 'Limit_0_2' ELSE 'Sort_0_1' END ||
        CASE WHEN attrs = '' THEN '' ELSE '|' || attrs END AS line FROM nodes),
    linear_plans AS (SELECT plan_id, string_agg(line, '' ORDER BY 2 - depth, width, node_id) AS plan_text FROM written GROUP BY plan_id)"""


@query(f"WITH {LINEARIZED_PLANS} SELECT o_orderkey AS plan_id, plan_text FROM orders LEFT JOIN linear_plans ON plan_id = o_orderkey")
def plan_linearize(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = shred.reflect_depth(shred.shred_plans(order_plans(spark, sf_dir)))
    return shred.linearize_plans(plans).select("plan_id", "plan_text")


@query(f"WITH {_PLANNED} SELECT node_type, count(*) AS n, count(DISTINCT plan_id) AS n_plans FROM nodes GROUP BY node_type")
def operator_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = shred.shred_plans(order_plans(spark, sf_dir), on_missing="drop")
    per_plan = shred.explode_nodes(plans, "plan_id").groupBy("node_type", "plan_id").agg(F.count("*").alias("k"))
    return per_plan.groupBy("node_type").agg(F.sum("k").alias("n"), F.count("*").alias("n_plans"))


@query(f"WITH {_PLANNED}, sizes AS (SELECT plan_id, count(*) AS n_nodes FROM nodes GROUP BY plan_id) SELECT n_nodes, count(*) AS n_plans FROM sizes GROUP BY n_nodes")
def plan_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = shred.shred_plans(order_plans(spark, sf_dir), on_missing="drop")
    return shred.size_histogram(shred.explode_nodes(plans, "plan_id"), "plan_id")


@query(
    """SELECT o_orderpriority AS grp, 6 * count(*) AS n_nodes, count(*) FILTER (o_orderkey % 3 = 0) + count(*) AS n_p,
      2 * count(*) FILTER (o_orderkey % 3 <> 0) AS n_c, count(*) AS n_s, count(*) FILTER (o_orderkey % 3 = 0) AS n_gb,
      0::BIGINT AS n_h, count(*) FILTER (o_orderkey % 3 <> 0) AS n_ob, count(*) FILTER (o_orderkey % 3 = 0) AS n_a,
      count(*) FILTER (o_orderkey % 3 = 0) AS n_op, count(*) FILTER (o_orderkey % 3 <> 0) AS n_l FROM orders GROUP BY o_orderpriority"""
)
def operator_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("o_custkey").cast("string")
    grouped = F.array(F.lit("c1"), F.lit("c2"), F.lit("gb"), F.lit("count"), F.concat(F.lit("- "), number), F.lit("where"))
    ranked = F.array(
        F.lit("c1"), F.concat(F.lit("> "), number), F.lit("="), F.lit("ob desc"), F.concat(F.lit("l "), number), F.lit("and")
    )
    texts = F.when(F.col("o_orderkey") % 3 == 0, grouped).otherwise(ranked)
    nodes = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("grp"), F.explode(texts).alias("node_text"))
    header = F.array(F.lit("c1"), F.lit("c2"))
    return shred.kind_histogram(nodes.withColumn("kind", shred.operator_kind(F.col("node_text"), header)), ["grp"])


_GEO_SQL = """
edges AS (
  SELECT n_regionkey AS graph_id, 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation
  UNION SELECT n_regionkey, 'n' || n_nationkey, 'c' || c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey
  UNION SELECT n_regionkey, 'r' || n_regionkey, 'c' || c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey
  UNION SELECT n_regionkey, 'c' || c_custkey, 'o' || o_orderkey FROM nation JOIN customer ON c_nationkey = n_nationkey
    JOIN orders ON o_custkey = c_custkey),
walks(graph_id, node, layer) AS (
  SELECT DISTINCT graph_id, src, 0 FROM edges e WHERE NOT EXISTS (SELECT 1 FROM edges f WHERE f.graph_id = e.graph_id AND f.dst = e.src)
  UNION SELECT w.graph_id, e.dst, w.layer + 1 FROM walks w JOIN edges e ON e.graph_id = w.graph_id AND e.src = w.node),
layers AS (SELECT graph_id, node, max(layer)::BIGINT AS layer FROM walks GROUP BY graph_id, node)
"""


@query(
    f"""WITH RECURSIVE {_GEO_SQL} SELECT graph_id, src AS node, 'source' AS side FROM edges EXCEPT SELECT graph_id, dst, 'source' FROM edges
    UNION ALL (SELECT graph_id, dst, 'sink' FROM edges EXCEPT SELECT graph_id, src, 'sink' FROM edges)"""
)
def dag_sources_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = geo_edges(spark, sf_dir)
    first = dags.sources(edges).withColumn("side", F.lit("source"))
    return first.unionByName(dags.sinks(edges).withColumn("side", F.lit("sink")))


@query(f"WITH RECURSIVE {_GEO_SQL} SELECT DISTINCT e.graph_id, e.dst AS node FROM edges e WHERE e.src LIKE 'n%'")
def dag_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = geo_edges(spark, sf_dir)
    nations = edges.where("src LIKE 'n%'").select("graph_id", F.col("src").alias("node")).distinct()
    return dags.neighbours(edges, nations)


@query(f"WITH RECURSIVE {_GEO_SQL} SELECT graph_id, src, dst FROM edges WHERE src NOT LIKE 'r%'")
def dag_peel(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = geo_edges(spark, sf_dir).distinct()
    return dags.peel(edges, dags.sources(edges))


@query("SELECT DISTINCT o_custkey AS graph_id FROM orders WHERE o_custkey % 2 = 1")
def dag_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One graph per customer: orders lead to the customer; with odd keys that leads back to them.
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("graph_id"), F.concat(F.lit("o"), "o_orderkey").alias("node"))
    up = orders.select("graph_id", F.col("node").alias("src"), F.lit("customer").alias("dst"))
    back = orders.where("graph_id % 2 = 1").select("graph_id", F.lit("customer").alias("src"), F.col("node").alias("dst"))
    return dags.graphs_without_sink(up.unionByName(back))


@query(f"WITH RECURSIVE {_GEO_SQL} SELECT * FROM layers")
def dag_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dags.layers(geo_edges(spark, sf_dir))[0]


@query(
    f"""WITH RECURSIVE {_GEO_SQL}, down(graph_id, start, node) AS (
      SELECT DISTINCT graph_id, src, src FROM edges WHERE src LIKE 'n%'
      UNION SELECT d.graph_id, d.start, e.dst FROM down d JOIN edges e ON e.graph_id = d.graph_id AND e.src = d.node)
    SELECT * FROM down WHERE start <> node"""
)
def dag_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = geo_edges(spark, sf_dir)
    nations = edges.where("src LIKE 'n%'").select("graph_id", F.col("src").alias("node"))
    return dags.reach(edges, nations)


# Orders in chains of 65 by their keys: 64 levels each.
_CHAIN_SQL = """
steps AS (
  SELECT o_orderkey // 65 AS graph_id, o_orderkey AS src, o_orderkey + 1 AS dst FROM orders
  WHERE o_orderkey % 65 < 64 AND o_orderkey + 1 IN (SELECT o_orderkey FROM orders))
"""


def chain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "orders").select("o_orderkey")
    steps = keys.where("o_orderkey % 65 < 64").select(F.floor(F.col("o_orderkey") / 65).alias("graph_id"), F.col("o_orderkey").alias("src"), (F.col("o_orderkey") + 1).alias("dst"))
    return steps.join(keys.withColumnRenamed("o_orderkey", "dst"), "dst", "left_semi").select("graph_id", "src", "dst")


@query(
    f"""WITH RECURSIVE {_CHAIN_SQL}, down(graph_id, start, node) AS (
      SELECT * FROM steps UNION SELECT d.graph_id, d.start, s.dst FROM down d JOIN steps s ON s.graph_id = d.graph_id AND s.src = d.node)
    SELECT * FROM down"""
)
def dag_chain_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dags.closure(chain_edges(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {_CHAIN_SQL}, walks(graph_id, node, layer) AS (
      SELECT graph_id, src, 0::BIGINT FROM steps WHERE src NOT IN (SELECT dst FROM steps)
      UNION ALL SELECT w.graph_id, s.dst, w.layer + 1 FROM walks w JOIN steps s ON s.graph_id = w.graph_id AND s.src = w.node)
    SELECT * FROM walks"""
)
def dag_chain_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dags.layers(chain_edges(spark, sf_dir))[0]


@query(
    f"""WITH RECURSIVE {_GEO_SQL}, up(graph_id, start, node) AS (
      SELECT DISTINCT graph_id, dst, dst FROM edges WHERE dst LIKE 'o%'
      UNION SELECT u.graph_id, u.start, e.src FROM up u JOIN edges e ON e.graph_id = u.graph_id AND e.dst = u.node)
    SELECT * FROM up WHERE start <> node"""
)
def dag_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = geo_edges(spark, sf_dir)
    orders = edges.where("dst LIKE 'o%'").select("graph_id", F.col("dst").alias("node"))
    return dags.reach(edges, orders, backward=True)


@query(
    f"""WITH RECURSIVE {_GEO_SQL}, placed AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY layer, node) AS pos FROM layers)
    SELECT graph_id, (pos - 1) // 4096 AS segment, string_agg(' NODE ' || node, '' ORDER BY pos) AS nodes_text
    FROM placed GROUP BY graph_id, (pos - 1) // 4096"""
)
def dag_layers_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dags.layers_text(dags.layers(geo_edges(spark, sf_dir))[0])


@query(
    f"""WITH {ORDER_LINES}, planned AS (SELECT * FROM orders WHERE o_totalprice >= 10000)
    SELECT o_orderkey AS graph_id, 0::BIGINT AS segment, ' NODE ' || CASE WHEN o_orderkey % 2 = 0 THEN 'Index Scan_1_2 NODE ' ELSE '' END ||
      'Seq Scan_0_2 NODE Sort_0_1 NODE Limit_0_0' AS "text" FROM planned
    UNION ALL SELECT o_orderkey, 1, ' col : l_partkey | l_quantity | l_extendedprice | l_discount | l_returnflag' || coalesce((
      SELECT string_agg(' row ' || row_pos || ' : ' || l_partkey || ' | ' || l_quantity || ' | ' || l_extendedprice || ' | ' || l_discount
        || ' | ' || l_returnflag, '' ORDER BY row_pos) FROM order_lines WHERE l_orderkey = o_orderkey), '') FROM planned"""
)
def dag_text_with_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A plan runs from its scans up, so edges lead from child to parent.
    plans = shred.shred_plans(order_plans(spark, sf_dir), on_missing="drop")
    layered, _ = dags.node_layers(*dags.plan_graphs(plans, "plan_id"))
    corpus = order_corpus(spark, sf_dir)
    return dags.text_with_table(dags.layers_text(layered), linearize(corpus.rows, corpus.meta))


@query(
    """SELECT o_orderkey AS graph_id, 0::BIGINT AS segment, [' NODE Limit_0_0', ' NODE Seq Scan_0_2 NODE Seq Scan_0_2 NODE Sort_0_1 NODE Sort_1_1 NODE Append_0_0',
      ' NODE Seq Scan_0_1 NODE Limit_0_0'][(o_orderkey % 3 + 1)::INT] AS nodes_text FROM orders"""
)
def plan_graph_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Plans of one node, and plans with nodes of one name under different parents.
    def plan(kind: str, *inner: str) -> str:
        return f"<Plan><Node-Type>{kind}</Node-Type>" + (f"<Plans>{''.join(inner)}</Plans>" if inner else "") + "</Plan>"

    sort = plan("Sort", plan("Seq Scan"))
    forms = [plan("Limit"), plan("Append", sort, sort), plan("Limit", plan("Seq Scan"))]
    whole = F.array(*[F.lit(f'<explain xmlns="http://www.postgresql.org/2009/explain"><Query>{f}</Query></explain>') for f in forms])
    xml = F.get(whole, (F.col("o_orderkey") % 3).cast("int"))
    plans = shred.shred_plans(spread(table(spark, sf_dir, "orders").select("o_orderkey")).select(F.col("o_orderkey").alias("plan_id"), xml.alias("xml_plan")))
    layered, _ = dags.node_layers(*dags.plan_graphs(plans, "plan_id"))
    return dags.layers_text(layered)
