"""Exact top-k against a plain sort over all pairs."""

import math
import random

import numpy as np
import pytest

from tablewright.llm import topk
from tablewright.llm.queries import REGISTRY
from tests.oracle import compare, duck

NAN, INF = float("nan"), float("inf")


def brute(rows, queries, k):
    out = []
    for q, own in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(own, other, strict=False)), i) for i, other in rows.items() if i != q)
        out += [(q, rank, i, -score) for rank, (score, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def random_rows(n, dims, values, seed):
    rng = random.Random(seed)
    return {i * 3: [rng.choice(values) for _ in range(dims)] for i in range(n)}


@pytest.mark.parametrize(("values", "blocks"), [([0, 0, 0, 1], (7, 4)), ([-3, 0, 2, 5], (1000, 3)), ([0], (10, 10)), ([2**29, -(2**29), 1], (16, 5))])
def test_blocks_give_the_same_rows(spark, values, blocks):
    rows = random_rows(60, 5, values, 1)
    df = spark.createDataFrame(list(rows.items()), "id long, weights array<long>")
    got = topk.top_k(df, df.where("id % 2 = 0"), 5, *blocks).collect()
    assert sorted(map(tuple, got)) == brute(rows, {i: v for i, v in rows.items() if i % 2 == 0}, 5)


def test_vectors(spark):
    rows = [(0, [0.1, -0.1]), (50, [0.5]), (50, [0.25]), (1, [None, 1.0]), (2, [NAN]), (3, [INF]), (4, None), (None, [1.0]), (5, []), (6, [1.0, 2.0, 3.0]), (6, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "vec_id long, embedding array<float>, id int, weights string")
    vectors = topk.integer_vectors(df, "vec_id", "embedding")
    got = sorted((r.id, r.weights) for r in vectors.collect())
    assert got == [(0, [math.floor(256 * np.float64(np.float32(0.1))), math.floor(256 * np.float64(np.float32(-0.1)))]), (5, []), (6, [256, 512, 768]), (6, [256, 512, 768]), (50, [64]), (50, [128])]
    # Every row is a candidate but the query's own, also where an id or a whole row repeats.
    best = []
    for at, (q, own) in enumerate(got):
        if q in (0, 6, 50):
            scored = sorted((-sum(a * b for a, b in zip(own, other, strict=False)), i) for j, (i, other) in enumerate(got) if j != at)
            best += [(q, rank, i, -score) for rank, (score, i) in enumerate(scored[:5], 1)]
    for blocks in ((8192, 8192), (2, 1)):
        assert sorted(map(tuple, topk.top_k(vectors, vectors.where("id in (0, 6, 50)"), 5, *blocks).collect())) == sorted(best)
    assert topk.top_k(vectors.where("false"), vectors.where("false")).count() == 0
    assert topk.top_k(vectors.where("id = 0"), vectors.where("id = 0")).count() == 0


@pytest.mark.parametrize("name", [n for n, r in REGISTRY.items() if r.sql])
def test_queries_match_their_sql(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    difference, _, _ = compare(spark, duck(sf_dir), REGISTRY[name].run, REGISTRY[name].sql, sf_dir)
    assert difference == ""
