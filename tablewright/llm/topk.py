"""Exact top-k search: every query against every row, term by term.

Vectors are sparse rows of integer weights; a vector position is a term. Rows are dealt into blocks by a hash of their
id, queries into blocks of their own, and every pair of blocks is one cell. Inside a cell each query scatters
``weight * posting`` of its terms into a dense array of scores, selects its best by partition, and only those leave the
cell; a rank over the cells merges them. The data sent is rows * query blocks + queries * row blocks, so both block
sizes bound the memory of a task and their growth lowers the traffic.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCORED = "query_id long, query_key long, vec_id long, score long"
# Queries scored together: their dense score arrays stay within the processor's cache.
SLICE = 16


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """``id, weights, copy``: floor(scale * x) of every component as double.

    Vectors that are null or hold a null, NaN or infinite component are left out, and so are rows without an id. Rows that repeat an id are rows
    of their own; ``copy`` numbers those that repeat the weights too.
    """
    x = F.col(vector_col)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & finite)
    weights = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    same = rows.select(F.col(id_col).cast("long").alias("id"), weights.alias("weights")).groupBy("id", "weights").agg(F.count("*").alias("n"))
    return same.select("id", "weights", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))


def _dense(lists: pa.ListArray, width: int) -> np.ndarray:
    """Weights as rows; a vector shorter than the others has no terms beyond its end."""
    lengths = np.asarray(pc.list_value_length(lists))
    flat = np.asarray(lists.flatten(), dtype=np.int64)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def best_in_cell(query_keys: np.ndarray, queries: np.ndarray, ids: np.ndarray, keys: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best rows of a cell for each query as (number of the query, id, score); ``ids`` ascend, ties go to the smaller. A query's own row has its key."""
    largest = int(np.abs(queries).sum(axis=1).max(initial=0)) * int(np.abs(rows).max(initial=0))
    kind = np.float64 if largest < 2**53 else np.int64  # doubles are exact up to there, and faster
    none = -np.inf if kind is np.float64 else np.iinfo(np.int64).min
    postings = []
    for term in range(rows.shape[1]):
        at = np.flatnonzero(rows[:, term])
        # A posting list that covers most rows is stored with its zeros, in row order.
        whole = 2 * len(at) > len(rows)
        postings.append((slice(None) if whole else at, rows[:, term].astype(kind) if whole else rows[at, term].astype(kind)))
    by_key = np.argsort(keys, kind="stable")
    own = np.searchsorted(keys, query_keys, sorter=by_key)
    own = np.where(own < len(keys), by_key[np.minimum(own, len(keys) - 1)], 0)
    found: tuple[list, list, list] = ([], [], [])
    scores = np.empty((SLICE, len(ids)), dtype=kind)
    product = np.empty((SLICE, len(ids)), dtype=kind)
    for first in range(0, len(query_keys), SLICE):
        part = queries[first : first + SLICE].astype(kind)
        n = len(part)
        scores[:n] = 0
        for term, (at, weights) in enumerate(postings):
            if not len(weights) or not part[:, term].any():
                continue
            if isinstance(at, slice):
                np.multiply(part[:, term, None], weights[None, :], out=product[:n])
                scores[:n] += product[:n]
            else:
                scores[:n, at] += part[:, term, None] * weights[None, :]
        for row in range(n):
            here, q = scores[row], first + row
            left = len(ids)
            if keys[own[q]] == query_keys[q]:
                here[own[q]] = none
                left -= 1
            take = min(k, left)
            if not take:
                continue
            least = np.partition(here, len(here) - take)[len(here) - take]
            above = np.flatnonzero(here > least)
            chosen = np.concatenate([above, np.flatnonzero(here == least)[: take - len(above)]])
            found[0].append(np.full(take, q))
            found[1].append(ids[chosen])
            found[2].append(here[chosen].astype(np.int64))
    return tuple(np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in found)


def _cell(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def score(queries: pa.Table, rows: pa.Table) -> pa.Table:
        names = ["query_id", "query_key", "vec_id", "score"]
        if not len(queries) or not len(rows):
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        rows = rows.sort_by("id")
        lists = [t.column("weights").combine_chunks() for t in (queries, rows)]
        width = max(pc.max(pc.list_value_length(x)).as_py() for x in lists)
        ids, keys = ([np.asarray(t.column(n), dtype=np.int64) for t in (queries, rows)] for n in ("id", "key"))
        asked, found, score = best_in_cell(keys[0], _dense(lists[0], width), ids[1], keys[1], _dense(lists[1], width), k)
        return pa.table(dict(zip(names, map(pa.array, (ids[0][asked], keys[0][asked], found, score)), strict=True)))

    return score


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, row_block: int = 8192, query_block: int = 8192) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query its k best rows other than itself (all, if fewer).

    Both inputs are ``id, weights``, and ``copy`` where rows repeat both. Exhaustive: nothing is pruned, so the work is queries * rows * terms.
    Scores are 64-bit integers. An empty side gives no rows.
    """
    queries, rows = (df.select("id", "weights", F.xxhash64(*[c for c in ("id", "weights", "copy") if c in df.columns]).alias("key")) for df in (queries, rows))
    row_blocks = max(1, -(-rows.count() // row_block))
    query_blocks = max(1, -(-queries.count() // query_block))
    block = lambda n: F.pmod("key", F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("query_block", block(query_blocks)).select("*", every(row_blocks).alias("row_block"))
    right = rows.withColumn("row_block", block(row_blocks)).select("*", every(query_blocks).alias("query_block"))
    cell = ["query_block", "row_block"]
    scored = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_cell(k), SCORED)
    order = W.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
