"""Groups that may be very large: measuring them, numbering their rows and cutting them in blocks.

A key may hold a large share of all rows. Aggregates combine before the shuffle and need
nothing more; everything that lists, numbers or joins the rows of a group goes through here,
so that no task ever receives more than a bounded piece of one group.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# A group up to this many rows may be sorted in one task.
HOT_ROWS = 1_000_000
# Lists and texts are built from at most this many rows of a group each.
BLOCK_ROWS = 4096
# Groups are counted in so many buckets of keys first: no group is larger than its bucket.
BUCKETS = 65_536


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Row count of the largest group: one aggregated number, from the key columns only."""
    top = df.groupBy(*keys).count().agg(F.max("count").alias("n")).first()
    return int(top["n"] or 0)


def has_larger_group(df: DataFrame, keys: list[str], rows: int) -> bool:
    """Whether a group has more than ``rows`` rows. Groups are counted one by one only where a bucket of keys holds more."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("bucket")
    return largest_group(df.select(bucket), ["bucket"]) > rows and largest_group(df, keys) > rows


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``.

    Where it names none, a session on this machine alone gets a new temporary folder; a cluster has to name one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured is None and current is None and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if current is None:
        spark.sparkContext.setCheckpointDir(configured or tempfile.mkdtemp(prefix="tablewright-"))
    return configured or spark.sparkContext.getCheckpointDir()


def row_positions(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    name: str = "row_pos",
    hot_rows: int = HOT_ROWS,
    hot: bool | None = None,
) -> DataFrame:
    """Number the rows of every group from 1 in the given order (columns, ascending unless ``-name``).

    Groups up to ``hot_rows`` are numbered by a window. With a larger group, or without keys,
    rows are spread by range over (keys, order), numbered inside each range, and shifted by the
    number of rows the group has in earlier ranges. ``hot`` says whether a group is larger, where that is known.
    """
    if keys and not (has_larger_group(df, keys, hot_rows) if hot is None else hot):
        window = W.partitionBy(*keys).orderBy(*sort_columns(order))
        return df.withColumn(name, F.row_number().over(window).cast("long"))
    return _range_positions(df, keys, order, name)


def sort_columns(order: list[str]) -> list[Column]:
    """Sort columns from names, descending where a name starts with ``-``."""
    return [F.desc_nulls_last(c[1:]) if c.startswith("-") else F.asc_nulls_first(c) for c in order]


def _range_positions(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    ranges = [F.asc_nulls_first(k) for k in keys] + sort_columns(order) + [F.asc("_copy")]
    # _copy separates equal rows, so that many copies of one row still spread over ranges.
    # The range of a row comes from sampling, so it is fixed by a checkpoint before it is used twice.
    ranged = (
        df.withColumn("_copy", F.monotonically_increasing_id())
        .repartitionByRange(*ranges)
        .withColumn("_range", F.spark_partition_id())
        .checkpoint()
    )
    per_range = ranged.groupBy(*keys, "_range").count()
    earlier = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    # A range continues at most one group, so at most one row per range has an offset: safe to broadcast.
    offsets = per_range.withColumn("_offset", F.sum("count").over(earlier)).where("_offset > 0").drop("count")
    inside = W.partitionBy(*keys, "_range").orderBy(*sort_columns(order), "_copy")
    condition = F.col("r._range") == F.col("o._range")
    for key in keys:
        condition &= F.col(f"r.{key}").eqNullSafe(F.col(f"o.{key}"))
    numbered = ranged.withColumn("_inside", F.row_number().over(inside))
    joined = numbered.alias("r").join(F.broadcast(offsets).alias("o"), condition, "left")
    position = (F.col("_inside") + F.coalesce(F.col("_offset"), F.lit(0))).cast("long")
    return joined.select(*[F.col(f"r.{c}").alias(c) for c in df.columns], position.alias(name))


def block_of(position: Column, block_rows: int = BLOCK_ROWS) -> Column:
    """Block number (from 0) of a row position (from 1)."""
    return F.floor((position - 1) / block_rows).cast("long")


def in_order(entries: Column, field: str) -> Column:
    """One field of a collected list of (position, ...) structs, in position order, NULLs kept."""
    return F.transform(F.sort_array(entries), lambda e: e[field])
