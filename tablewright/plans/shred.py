"""Plan XML documents to node lists.

A document is read where it lies: one pass over its tags, in Arrow batches, gives its list of nodes, so a corpus of
plans is shredded, reflected and written as text without any shuffle, in time that grows with the documents' length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.binding import let
from tablewright.plans.reader import read_nodes

# Tags whose content is measured or physical and says nothing about the plan itself.
IGNORED_TAGS = [
    "Startup-Cost",
    "Total-Cost",
    "Plan-Rows",
    "Plan-Width",
    "Actual-Startup-Time",
    "Actual-Total-Time",
    "Actual-Rows",
    "Actual-Loops",
    "Planning-Time",
    "Triggers",
    "Execution-Time",
    "Parallel-Aware",
    "Async-Capable",
    "Rows-Removed-by-Filter",
    "Partial-Mode",
    "Strategy",
    "Parent-Relationship",
    "Sort-Space-Used",
    "Sort-Space-Type",
    "Sort-Method",
    "Rows-Removed-by-Index-Recheck",
    "HashAgg-Batches",
    "Peak-Memory-Usage",
    "Disk-Usage",
    "Subplans-Removed",
    "Rows-Removed-by-Join-Filter",
    "Hash-Buckets",
    "Original-Hash-Buckets",
    "Hash-Batches",
    "Original-Hash-Batches",
    "Heap-Fetches",
]
# The shorter list of the older node tables, whose child positions count from 1.
OLDER_IGNORED_TAGS = IGNORED_TAGS[:13]


def shred_plans(
    plans: DataFrame,
    xml: str = "xml_plan",
    ignored: list[str] = IGNORED_TAGS,
    first_width: int = 0,
    on_missing: str = "keep",
) -> DataFrame:
    """Adds ``nodes``: one entry per plan node in document order, NULL where there is no plan.

    A node has ``node_id`` (document position), ``parent_id``, ``node_type``, ``width`` (place among its
    siblings), ``depth`` and ``attrs`` (``Tag``, or ``Outer_Tag`` inside a holder such as a sort key list).
    With ``on_missing='drop'`` rows without a plan are left out.
    """
    if on_missing == "drop":
        plans = plans.where(F.col(xml).isNotNull())
    return plans.withColumn("nodes", read_nodes(F.col(xml), ignored, first_width))


def reflect_depth(plans: DataFrame) -> DataFrame:
    """Count depth from the bottom: the deepest level becomes 0 and the root the highest."""

    def reflected(nodes: Column) -> Column:
        deepest = F.array_max(F.transform(nodes, lambda n: n["depth"]))
        return let(deepest, lambda d: F.transform(nodes, lambda n: n.withField("depth", d - n["depth"])))

    return plans.withColumn("nodes", let(F.col("nodes"), reflected))


def explode_nodes(plans: DataFrame, *keys: str) -> DataFrame:
    """The node table: one row per node, with the given plan columns."""
    # The outer form keeps Spark from testing the list for emptiness first, which would shred every plan twice.
    return plans.select(*keys, F.inline_outer("nodes")).where("node_id IS NOT NULL")


def node_name(node: Column) -> Column:
    """``Type_width_depth``."""
    return F.concat_ws("_", node["node_type"], node["width"].cast("string"), node["depth"].cast("string"))


def linearize_plans(
    plans: DataFrame,
    separator: str = " NODE ",
    mark: str = "|",
    with_position: bool = True,
    with_parent: bool = True,
    last_only: bool = False,
    order: str = "depth",
) -> DataFrame:
    """Adds ``plan_text``: each node as ``type|width|depth|parent|key : value…`` after a separator.

    Nodes are ordered by (depth, width, document position), or by name text with ``order='name'``.
    ``last_only`` keeps the last of repeated attribute keys. A missing plan stays NULL.
    """

    def attributes(attrs: Column) -> Column:
        if last_only:
            later = attrs
            attrs = F.filter(
                attrs, lambda a, i: ~F.exists(F.slice(later, i + 2, F.size(later)), lambda b: b["key"] == a["key"])
            )
        return F.transform(attrs, lambda a: F.concat(a["key"], F.lit(" : "), a["value"]))

    def written(node: Column, names: Column) -> Column:
        head = [node["node_type"]]
        if with_position:
            head += [node["width"].cast("string"), node["depth"].cast("string")]
        if with_parent:
            # Node ids are document positions, so the parent is found by position.
            head.append(F.coalesce(F.get(names, node["parent_id"]), F.lit("Query")))
        text = F.array_join(F.concat(F.array(*head), attributes(node["attrs"])), mark)
        rank = (
            F.struct(node_name(node).alias("name"), node["node_id"].alias("at"))
            if order == "name"
            else F.struct(node["depth"].alias("depth"), node["width"].alias("width"), node["node_id"].alias("at"))
        )
        return F.struct(rank.alias("rank"), F.concat(F.lit(separator), text).alias("text"))

    def text(nodes: Column) -> Column:
        names = F.transform(nodes, lambda n: node_name(n))
        lines = let(names, lambda known: F.sort_array(F.transform(nodes, lambda n: written(n, known))))
        return F.array_join(F.transform(lines, lambda n: n["text"]), "")

    return plans.withColumn("plan_text", let(F.col("nodes"), text))


def operator_kind(node_text: Column, header: Column) -> Column:
    """The kind of a graph node by its text.

    A aggregate, S selection, OP arithmetic, C comparison, L limit, P column, GB group, OB order, H having;
    any other text is a value, kind V.
    """
    # The words of each kind.
    aggregates = ["min", "max", "sum", "avg", "abs", "julianday", "count", "distinct", "length"]
    arithmetic = ["+", "-", "/"]
    comparisons = [">", ">=", "<=", "<", "=", "!=", "in", "is", "intersect", "union", ","]
    first, last = F.substring_index(node_text, " ", 1), F.substring_index(node_text, " ", -1)
    is_result = F.contains(node_text, F.lit("| "))

    def led_by(words: list[str]) -> Column:
        return node_text.isin(*words) | ((first.isin(*words) | last.isin(*words)) & ~is_result)

    return (
        F.when(node_text.isin(*aggregates), F.lit("A"))
        .when(node_text.isin("where", "and", "or"), F.lit("S"))
        .when(led_by(arithmetic), F.lit("OP"))
        .when(led_by(comparisons), F.lit("C"))
        .when(node_text.rlike(r"^l \d+$"), F.lit("L"))
        .when(F.array_contains(header, node_text), F.lit("P"))
        .when(node_text == "gb", F.lit("GB"))
        .when(node_text.isin("ob", "ob ob", "ob asc", "ob desc"), F.lit("OB"))
        .when(F.lower(node_text) == "h", F.lit("H"))
        .otherwise(F.lit("V"))
    )


# The kinds counted per plan.
KINDS = ["P", "C", "S", "GB", "H", "OB", "A", "OP", "L"]


def kind_histogram(nodes: DataFrame, keys: list[str], kind: str = "kind") -> DataFrame:
    """Number of nodes of each kind per key, with the node count of the key."""
    counts = [F.count_if(F.col(kind) == k).alias(f"n_{k.lower()}") for k in KINDS]
    return nodes.groupBy(*keys).agg(F.count("*").alias("n_nodes"), *counts)


def size_histogram(nodes: DataFrame, plan: str) -> DataFrame:
    """How many plans have each node count."""
    return nodes.groupBy(plan).agg(F.count("*").alias("n_nodes")).groupBy("n_nodes").agg(F.count("*").alias("n_plans"))
