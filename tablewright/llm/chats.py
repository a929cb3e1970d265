"""Chat formatting: logged conversations collapse to the longest ones, which are then rendered as text.

A chat log often holds a conversation again after each turn, so most rows are prefixes of a longer one. Every turn carries a rolling hash of its
prefix: the hash before it combined with the hash of its place, role and text. A conversation whose last hash is an inner hash of some other
is a snapshot of that one and is dropped by an anti-join on (length, hash); of equal conversations the smallest id stays.

Turns are numbered and hashed in pieces of a bounded range of turn numbers, and pieces are then chained, so a conversation of any length
is never sorted in one task. Rendered text comes in segments of a bounded number of turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.llm.common import written

# Turn numbers that are ordered together, and turns in one segment of rendered text.
PIECE = 256
SEGMENT = 1000
HASHES = ["h1", "h2"]


def numbered(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, role, text, h1, h2``: turns in order, each with the 128-bit hash of its prefix.

    Turns are ordered by turn number (missing ones first), then role and text; rows that repeat count once. A missing role is ``unknown``, a
    missing text is empty. Turns without a conversation id belong to none and are left out.
    """
    rows = turns.where("conv_id IS NOT NULL").select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    piece = F.coalesce(F.floor(F.col("turn") / PIECE), F.lit(-(2**62))).cast("long")
    rows = rows.distinct().withColumn("piece", piece)
    inside = W.partitionBy("conv_id", "piece").orderBy(F.asc_nulls_first("turn"), "role", "text")
    earlier = W.partitionBy("conv_id").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("place", F.row_number().over(inside))
    counts = rows.groupBy("conv_id", "piece").count()
    offsets = counts.select("conv_id", "piece", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("offset"))
    placed = rows.join(offsets, ["conv_id", "piece"]).withColumn("pos", F.col("place") + F.col("offset"))
    for seed, name in enumerate(HASHES):
        placed = placed.withColumn(name, F.xxhash64(F.lit(seed), "pos", "role", "text"))
    whole = placed.groupBy("conv_id", "piece").agg(*[F.bit_xor(h).alias(f"{h}_whole") for h in HASHES])
    before = whole.select("conv_id", "piece", *[F.coalesce(F.bit_xor(f"{h}_whole").over(earlier), F.lit(0)).alias(f"{h}_before") for h in HASHES])
    so_far = W.partitionBy("conv_id", "piece").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    chained = placed.join(before, ["conv_id", "piece"])
    hashes = [F.bit_xor(h).over(so_far).bitwiseXOR(F.col(f"{h}_before")).alias(h) for h in HASHES]
    return chained.select("conv_id", "pos", "role", "text", *hashes)


def maximal(prefixes: DataFrame) -> DataFrame:
    """``conv_id, n_turns, n_copies`` of the conversations that are no prefix of a longer one, equal ones once."""
    key = ["pos", *HASHES]
    ends = prefixes.groupBy("conv_id").agg(F.max(F.struct(*key)).alias("end"))
    own = ends.select("conv_id", "end.*").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    length = ends.select("conv_id", F.col("end.pos").alias("n_turns"))
    inner = prefixes.join(length, "conv_id").where("pos < n_turns").select(*key).distinct()
    return own.join(inner, key, "left_anti").select("conv_id", F.col("pos").alias("n_turns"), "n_copies")


def render(role: str = "role", text: str = "text"):
    """One turn as ``<|role|>``, its text and ``<|end|>``; a ``<|`` inside is written ``<\\|``, so markers are never forged."""
    safe = lambda c: F.replace(F.col(c), F.lit("<|"), F.lit("<\\|"))
    return F.concat(F.lit("<|"), safe(role), F.lit("|>\n"), safe(text), F.lit("<|end|>\n"))


def format_chats(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``conv_id, segment, n_turns, n_copies, text`` of every maximal conversation of ``turns`` (conv_id, turn, role, text).

    A conversation of up to ``segment`` turns is one row; a longer one has several, whose texts joined in order are the whole. ``n_copies``
    counts the equal conversations it stands for, itself included.
    """
    prefixes = written(numbered(turns), "turns")
    kept = maximal(prefixes.select("conv_id", "pos", *HASHES))
    rows = prefixes.select("conv_id", "pos", "role", "text").join(kept, "conv_id")
    parts = rows.withColumn("segment", F.floor((F.col("pos") - 1) / segment).cast("int"))
    turn = F.struct("pos", render().alias("text"))
    texts = parts.groupBy("conv_id", "segment", "n_turns", "n_copies").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return texts.select("conv_id", "segment", "n_turns", "n_copies", F.array_join("turns.text", "").alias("text"))
