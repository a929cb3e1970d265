"""Near copies among vectors by a pivot-permutation index.

A vector is described by the reference points (pivots) nearest to it, in order. Vectors at a small angle see the pivots in nearly the same order, so they
share most of their ``NEAREST`` first ones. Every vector stands in the inverted lists of its rarest pivots; two vectors that share at least
``SHARED`` pivots meet in the list of the first pivot they share, are counted there and only there, and are verified by their exact cosine.

Equal vectors are one class with a weight, so copies are never paired. A list of any length is cut in blocks, and a task gets two blocks of a list: it
sends back the number of links of each row and one edge of a spanning forest for each, never the pairs themselves.

The index may miss a link between vectors whose descriptions share fewer pivots; the README gives its measured recall. A link is never wrong.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from tablewright.llm.common import bounded_batches, lean_memory, written
from tablewright.llm.components import components

# Pivots in a description, and how many of them two vectors have to share to be verified.
NEAREST, SHARED = 12, 5
# Pivots grow with the square root of the number of different vectors, in powers of two; they are chosen from a sample of SAMPLE rows for each pivot.
FEWEST_PIVOTS, MOST_PIVOTS, SAMPLE = 64, 4096, 4
# Rows of a list in one block, and entries of the score table of one step inside a task.
BLOCK, STEP = 4096, 250_000
SALTS = 16
# A class is known by its smallest id (a class without any id comes last) and the 128-bit hash of its label and vector; nodes compare by id first.
NODE = "struct<no_id:boolean,id:bigint,k1:bigint,k2:bigint>"


def hashes(*columns: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), *columns).alias(f"k{seed}") for seed in (1, 2)]


def vector_classes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows as ``id, k1, k2`` (no hashes for a row that links with nothing), and ``label, dim, node, weight, vec`` of the different vectors."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    usable = F.coalesce(F.col(label_col).isNotNull() & finite & F.exists(x, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.when(usable, x).alias("vec"))
    keyed = rows.select("*", *[F.when(F.col("vec").isNotNull(), k).alias(name) for k, name in zip(hashes(F.col("label"), F.col("vec")), ("k1", "k2"), strict=True)])
    same = keyed.where("vec IS NOT NULL").groupBy("label", "k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.first("vec").alias("vec"))
    node = F.struct(F.col("id").isNull().alias("no_id"), "id", "k1", "k2").cast(NODE).alias("node")
    return keyed.select("id", "k1", "k2"), same.select("label", F.size("vec").alias("dim"), node, "weight", "vec")


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as unit rows of ``width`` components; longer ones are cut there, shorter ones end in zeros."""
    lengths = np.asarray(lists.value_lengths(), dtype=np.int64)
    flat = np.asarray(lists.flatten(), dtype=np.float64)
    out = np.zeros((len(lengths), width))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.empty(0, dtype=np.int64)
    if len(set(lengths.tolist())) == 1 and lengths[0] == width:
        out = flat.reshape(-1, width).copy()
    else:
        for row, (start, length) in enumerate(zip(starts, lengths, strict=True)):
            out[row, : min(length, width)] = flat[start : start + min(length, width)]
    # Scaled by the largest component first, so that neither very small nor very large ones are lost in the squares.
    largest = np.abs(out).max(axis=1, initial=0, keepdims=True)
    out /= np.where(largest > 0, largest, 1)
    norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norms > 0, norms, 1)


def choose_pivots(classes: DataFrame, n_classes: int) -> np.ndarray:
    """Pivots as unit rows: far points of a bounded sample, each the one least like all chosen before it.

    The sample has ``SAMPLE`` rows for each pivot, 16,384 at most, taken by the order of their hashes.
    """
    wanted = int(np.clip(2 ** np.ceil(np.log2(2 * np.sqrt(max(n_classes, 1)))), FEWEST_PIVOTS, MOST_PIVOTS))
    taken = classes.orderBy("node.k1", "node.k2").limit(SAMPLE * wanted).select("vec").toArrow().column("vec").combine_chunks()
    if not len(taken):
        return np.zeros((0, 0))
    sample = _matrix(taken, int(np.max(np.asarray(taken.value_lengths()))))
    chosen = [0]
    closest = sample @ sample[0]
    while len(chosen) < min(wanted, len(sample)):
        chosen.append(int(np.argmin(closest)))
        np.maximum(closest, sample @ sample[chosen[-1]], out=closest)
    return sample[chosen]


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, count: int = NEAREST) -> np.ndarray:
    """The numbers of the ``count`` nearest pivots (all, if fewer) of each row, nearest first; equal ones by number."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :count].astype(np.int32)


def described(classes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The classes with ``pivots``, their nearest ones in order; one pass in place."""
    points = classes.sparkSession.sparkContext.broadcast(pivots)
    schema = StructType([*classes.schema.fields]).add("pivots", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        for batch in batches:
            at = batch.schema.get_field_index("vec")
            for start in range(0, batch.num_rows, max(1, 4_000_000 // max(1, len(points.value)))):
                part = batch.slice(start, max(1, 4_000_000 // max(1, len(points.value))))
                found = nearest_pivots(_matrix(part.column(at), points.value.shape[1]), points.value)
                lists = pa.ListArray.from_arrays(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "pivots"])

    return bounded_batches(classes).mapInArrow(run, schema)


class SharedPivots:
    """Inverted lists over the rows of a block: how many pivots a row shares with each of them."""

    def __init__(self, ranks: np.ndarray):
        self.rows, width = ranks.shape
        order = np.argsort(ranks, axis=None, kind="stable")
        self.ranks, self.members = ranks.ravel()[order], order // width

    def count(self, asked: np.ndarray, below: int | None = None) -> np.ndarray:
        """One row of counts for each row of ``asked``; with ``below``, only of pivots with a smaller rank."""
        wanted, row = asked.ravel(), np.repeat(np.arange(len(asked)), asked.shape[1])
        if below is not None:
            wanted, row = wanted[(small := wanted < below)], row[small]
        first = np.searchsorted(self.ranks, wanted, "left")
        lengths = np.searchsorted(self.ranks, wanted, "right") - first
        within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        cells = np.repeat(row, lengths) * self.rows + self.members[np.repeat(first, lengths) + within]
        return np.bincount(cells, minlength=len(asked) * self.rows).reshape(len(asked), self.rows)


def _join_groups(group: np.ndarray, row: int, linked: np.ndarray) -> None:
    """Merge the groups of a row and of the rows linked with it; a group is known by its smallest row."""
    met = np.unique(np.append(group[linked], group[row]))
    if len(met) > 1:
        group[np.isin(group, met[1:])] = met[0]


def _cell(threshold: float, shared: int) -> Callable[[pa.Table], pa.Table]:
    """Links between two blocks of one inverted list, or inside one block."""
    names = ["no_id", "id", "k1", "k2"]

    def links(cell: pa.Table) -> pa.Table:
        lean_memory()
        cell = cell.sort_by([(n, "ascending") for n in names])
        left, right, rank = (cell.column(n)[0].as_py() for n in ("left", "right", "rank"))
        block, weights = np.asarray(cell.column("block")), np.asarray(cell.column("weight"))
        ranks = cell.column("ranks").combine_chunks()
        ranks = np.asarray(ranks.flatten()).reshape(len(ranks), -1)
        vectors = _matrix(cell.column("vec").combine_chunks(), cell.column("dim")[0].as_py())
        here, there = np.flatnonzero(block == left), np.flatnonzero(block == right)
        found = np.zeros(len(cell), dtype=np.int64)
        group = np.arange(len(cell))
        if len(here) and len(there):
            lists, height = SharedPivots(ranks[there]), max(1, STEP // len(there))
            for start in range(0, len(here), height):
                rows = here[start : start + height]
                # Pairs that share a pivot before this one are another list's.
                meet = (lists.count(ranks[rows]) >= shared) & (lists.count(ranks[rows], rank) == 0)
                if left == right:
                    meet[np.arange(len(rows)), np.arange(start, start + len(rows))] = False
                if not meet.any():
                    continue
                meet &= vectors[rows] @ vectors[there].T >= threshold
                found[rows] += meet @ weights[there]
                if left != right:
                    found[there] += weights[rows] @ meet
                for at in np.flatnonzero(meet.any(axis=1)):
                    _join_groups(group, rows[at], there[meet[at]])
        hit = np.flatnonzero(found)
        ids = cell.select(names)
        node, root = (ids.take(pa.array(at)).combine_chunks().to_struct_array() for at in (hit, group[hit]))
        flat = lambda x: x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
        return pa.table({"node": flat(node), "root": flat(root), "links": pa.array(found[hit])})

    return links


def block_links(classes: DataFrame, pivots: np.ndarray, threshold: float) -> DataFrame:
    """``node, root, links``: for each block of a list that a class has links in, their weight there and the smallest class they lead to."""
    rows = written(described(classes, pivots), "described")
    shared = min(SHARED, len(pivots))
    held = rows.select(F.explode("pivots").alias("pivot")).groupBy("pivot").count().collect()  # a row for each pivot
    rank = {r["pivot"]: place for place, r in enumerate(sorted(held, key=lambda r: (r["count"], r["pivot"])))}
    ranks = F.array(*[F.lit(rank.get(p, 0)) for p in range(len(pivots))])
    ranked = rows.withColumn("ranks", F.array_sort(F.transform("pivots", lambda p: F.get(ranks, p)))).drop("pivots")
    # Two sets that share so many pivots have the first one they share among these.
    leading = F.slice("ranks", 1, min(NEAREST, len(pivots)) - shared + 1)
    key = ["label", "dim", "rank"]
    places = ranked.select("label", "dim", F.explode(leading).alias("rank"))
    lists = places.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    # A list's size is told to its rows in SALTS parts, so a long list is no hot key of this join.
    salted = lists.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    own = F.pmod("node.k2", F.lit(SALTS)).cast("int").alias("salt")
    postings = ranked.select("*", own, F.explode(leading).alias("rank")).join(salted, [*key, "salt"]).drop("salt")
    dealt = postings.withColumn("block", F.pmod("node.k1", "blocks").cast("int"))
    cells = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        *key, "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "node.*", "weight", "vec", "ranks"
    )
    # Dealt by cell: the join's partitions would keep all blocks of a list together.
    cell = [*key, "left", "right"]
    found = cells.repartition(*cell).groupBy(*cell).applyInArrow(_cell(threshold, shared), f"node {NODE}, root {NODE}, links long")
    return written(found, "links")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98) -> DataFrame:
    """``id_col, n_links, component_id, kept`` for every row of ``vectors``.

    Rows link when their labels are equal and not null, their vectors have the same length and a cosine of at least ``threshold`` in double
    precision. ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest id reachable by links, ``kept`` tells whether that is the
    row's own. A vector that is null, empty, zero or holds a null or non-finite component links with nothing. Rows that repeat an id are rows of their own; rows
    without an id link like others, are never kept, and have no component id when nothing they reach has one. Other columns are not read;
    an empty table gives no rows.
    """
    rows, different = vector_classes(vectors, id_col, vector_col, label_col)
    classes = written(different, "vectors")
    n_classes = classes.count()
    own = classes.select("node", F.col("node").alias("root"), (F.col("weight") - 1).alias("links"))
    if n_classes > 1:
        links = block_links(classes, choose_pivots(classes, n_classes), threshold)
        reached = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")).distinct())
        own = own.unionAll(links.select("node", "node", "links")).unionAll(reached.select("node", "root", F.lit(0).cast("long")))
    judged = own.groupBy("node").agg(F.sum("links").alias("n_links"), F.min("root").alias("root"))
    joined = rows.join(judged.select("node.k1", "node.k2", "n_links", F.col("root.id").alias("component_id"), F.lit(True).alias("linked")), ["k1", "k2"], "left")
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("id"))
    return joined.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept")
    )
