"""Data set preparation: chunks, splits, samples, length limits, hold-outs and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.text import token_count
from tablewright.operators.relational import except_ids, top_per_group
from tablewright.sources.datasets import path_exists

# Rows per chunk of a resumable conversion.
CHUNK_ROWS = 100_000


def chunk_of(line_no: Column, chunk_rows: int = CHUNK_ROWS) -> Column:
    """Chunk number of a line, both counting from 0."""
    return F.floor(line_no / chunk_rows).cast("long")


# What a chunk's lines are known by, in any order: their number, and two sums over hashes of whole lines.
CHUNK_STATE = ["n_lines", "hash_sum", "hash_xor"]


def chunk_states(lines: DataFrame) -> DataFrame:
    """``chunk_id, n_lines, hash_sum, hash_xor`` of lines with a ``chunk_id``; the same for the same lines in any order."""
    line = [F.col(c) for c in lines.columns]
    hashed = lines.select("chunk_id", F.xxhash64(F.lit(1), *line).cast("decimal(38,0)").alias("a"), F.xxhash64(F.lit(2), *line).alias("b"))
    return hashed.groupBy("chunk_id").agg(F.count("*").alias("n_lines"), F.sum("a").alias("hash_sum"), F.bit_xor("b").alias("hash_xor"))


def current_chunks(spark: SparkSession, manifest: str, schema: T.StructType) -> tuple[int, DataFrame]:
    """The number of the last complete commit (0: none), and its list of chunks.

    A commit holds one row for each chunk and one that tells their number, so a commit of which files are missing does not count.
    """
    if not path_exists(spark, manifest):
        return 0, spark.createDataFrame([], schema)
    every = spark.read.schema(schema).parquet(manifest)
    commits = every.groupBy("commit").agg(F.count("chunk_id").alias("n"), F.max(F.when(F.col("chunk_id").isNull(), F.col("n_lines"))).alias("told"))
    last = commits.where("n = told").agg(F.max("commit").alias("last")).first()["last"] or 0
    return last, every.where((F.col("commit") == last) & F.col("chunk_id").isNotNull())


def convert_chunks(
    lines: DataFrame,
    convert: Callable[[DataFrame], DataFrame],
    out_dir: str,
    chunk_rows: int = CHUNK_ROWS,
    start_chunk: int = 0,
    end_chunk: int | None = None,
) -> DataFrame:
    """Convert ``lines(line_no, ...)`` by chunk and return the converted chunks as they are now.

    Of the chunks from ``start_chunk`` on and below ``end_chunk``, those are converted whose lines differ from what was converted last:
    new, grown, shrunk and edited ones are replaced whole, and those without lines are gone; the others stay as they are. A chunk whose lines all fail is not tried again while
    it stays the same. ``convert`` must keep ``chunk_id``.

    Results lie in ``out_dir`` by run and chunk. A manifest beside it lists for each commit which run holds which chunk. It is written
    last, so a failed run changes nothing and can be repeated, and readers see whole commits only.
    """
    spark = lines.sparkSession
    chunk = chunk_of(F.col("line_no"), chunk_rows)
    wanted = lambda c: (c >= start_chunk) & (F.lit(True) if end_chunk is None else c < end_chunk)
    todo = lines.withColumn("chunk_id", chunk).where(wanted(chunk))
    manifest = out_dir.rstrip("/") + ".manifest"
    seen = chunk_states(todo)
    schema = T.StructType([*seen.schema, T.StructField("run", T.LongType()), T.StructField("commit", T.LongType())])
    last, known = current_chunks(spark, manifest, schema)
    commit = last + 1
    runs = known.select("chunk_id", *CHUNK_STATE, "run")
    listed = seen.join(runs, ["chunk_id", *CHUNK_STATE], "left").withColumn("run", F.coalesce("run", F.lit(commit).cast("long")))
    elsewhere = runs.where(~wanted(F.col("chunk_id")))
    # One row for each chunk of 100,000 lines; written before the conversion, which reads it.
    planned = f"{manifest}.planned/{commit}"
    listed.unionByName(elsewhere).select("chunk_id", *CHUNK_STATE, "run").write.mode("overwrite").parquet(planned)
    plan = spark.read.schema(T.StructType(schema.fields[:-1])).parquet(planned)
    new = plan.where(F.col("run") == commit).select("chunk_id")
    converted = convert(todo.join(new, "chunk_id", "left_semi"))
    # A task writes whole chunks, which are of bounded size.
    converted.repartition("chunk_id").write.mode("overwrite").partitionBy("chunk_id").parquet(f"{out_dir}/run={commit}")
    end = plan.agg(F.count("*").alias("n_lines")).select(F.lit(None).cast("long").alias("chunk_id"), "n_lines", F.lit(None).cast("decimal(38,0)").alias("hash_sum"), F.lit(None).cast("long").alias("hash_xor"), F.lit(None).cast("long").alias("run"))
    plan.unionByName(end).withColumn("commit", F.lit(commit).cast("long")).coalesce(1).write.mode("append").parquet(manifest)
    kept = [f for f in converted.schema if f.name != "chunk_id"]
    partitioned = T.StructType([*kept, T.StructField("run", T.LongType()), T.StructField("chunk_id", T.LongType())])
    return spark.read.schema(partitioned).parquet(out_dir).join(plan, ["run", "chunk_id"], "left_semi").select(converted.columns)


def split_of(identity: Column, seed: int, test: float = 0.2, validation: float = 0.25) -> Column:
    """``test``, ``validation`` or ``train`` by a hash of id and seed: the same for a row wherever it is.

    ``test`` is a share of all rows, ``validation`` a share of the rest.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), identity.cast("string")))
    # Eight hex digits give a number below 2^32.
    share = F.conv(F.left(digest, F.lit(8)), 16, 10).cast("double") / F.lit(float(2**32))
    up_to = test + (1 - test) * validation
    return F.when(share < test, F.lit("test")).when(share < up_to, F.lit("validation")).otherwise(F.lit("train"))


def ensure_splits(df: DataFrame, identity: str, seed: int) -> DataFrame:
    """Keep the ``split`` column when it holds all three splits, else split anew."""
    names = ["train", "validation", "test"]
    if "split" in df.columns:
        held = df.where(F.col("split").isin(*names)).select("split").distinct().count()
        if held == len(names):
            return df
    return df.withColumn("split", split_of(F.col(identity), seed))


def as_train(df: DataFrame) -> DataFrame:
    """A set without splits is training data."""
    return df.withColumn("split", F.lit("train"))


def first_of_split(df: DataFrame, n: int, identity: str, split: str = "split") -> DataFrame:
    """The first ``n`` rows of every split by id."""
    return top_per_group(df, [split], n, [identity]).drop("rank")


def within_length(df: DataFrame, text: str, limit: int) -> DataFrame:
    """Rows whose text has at most ``limit`` tokens; adds ``n_tokens``."""
    return df.withColumn("n_tokens", token_count(F.col(text))).where(F.col("n_tokens") <= limit)


def length_report(df: DataFrame, text: str, limit: int, keys: list[str]) -> DataFrame:
    """How many rows fit the limit, per key."""
    fits = token_count(F.col(text)) <= limit
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(fits).alias("n_kept"))


def drop_failed(df: DataFrame, status: str = "status") -> DataFrame:
    return df.where(F.col(status) == "ok")


def status_report(df: DataFrame, status: str = "status") -> DataFrame:
    """Rows per status."""
    return df.groupBy(status).agg(F.count("*").alias("n"))


def held_out(
    df: DataFrame, identity: str, validation: list[DataFrame], train: list[DataFrame], known: DataFrame
) -> DataFrame:
    """Rows whose id is in a validation set, in no training set, and among the known ids."""
    ids = except_ids(validation, train).join(known.select(identity), identity, "left_semi")
    return df.join(ids, identity, "left_semi")
