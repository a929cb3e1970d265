"""Connected components over an edge table, by alternating stars; no node's neighbours are ever collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of every node on its smallest one: those above the node (large star), or those below and itself (small star)."""
    seen = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = seen.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
    moved = seen.join(least, "u")
    if large:
        hung = moved.where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        hung = moved.select(F.col("v").alias("u"), F.col("least").alias("v")).unionAll(least.select("u", F.col("least").alias("v")))
    ordered = hung.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return ordered.distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node that has an edge: the smallest node it is connected with. Input ``u, v`` in any order, loops allowed."""
    ordered = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now = written(ordered, "edges")
    before = state(now)
    while before[0]:
        now = written(_star(_star(now, True), False), "edges")
        after = state(now)
        if after == before:
            break
        before = after
    # Every edge now hangs on its component's smallest node.
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select("v", "v").distinct())
