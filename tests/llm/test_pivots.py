"""Near vectors against all pairs: links, components and recall; blocks of hot lists; edge rows; the query against SQL."""

import math

import numpy as np
import pytest

from tablewright.llm import pivots
from tablewright.llm.queries import REGISTRY
from tests.oracle import compare, duck

SCHEMA = "vec_id long, embedding array<double>, label int, node string, weight int"
NAN = float("nan")


def brute(rows, threshold=0.98):
    """``(id, links, component)`` of every row, by all pairs."""
    usable = [label is not None and bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    unit = [np.array(v) / np.linalg.norm(v) if ok else None for (_, v, _), ok in zip(rows, usable, strict=True)]
    near = [[j for j in range(len(rows)) if j != i and usable[i] and usable[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            new = set(near[todo.pop()]) - seen
            seen |= new
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((str(rows[i][0]), len(near[i]), str(min(ids)) if ids else "None", bool(ids) and rows[i][0] == min(ids)))
    return sorted(out)


def clusters(seed, sizes, spread, width=32, labels=3):
    rng = np.random.default_rng(seed)
    out = []
    for number, size in enumerate(sizes):
        centre = rng.normal(size=width)
        for _ in range(size):
            out.append(((centre + rng.normal(size=width) * spread * rng.random()).tolist(), number % labels))
    order = rng.permutation(len(out))
    return [(int(i), *out[k]) for i, k in enumerate(order)]


def result(spark, rows):
    df = spark.createDataFrame([(*r, "x", 9) for r in rows], SCHEMA)
    return sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in pivots.near_vectors(df).collect())


@pytest.mark.parametrize("block", [4096, 16])
def test_links_and_components_match_all_pairs(spark, monkeypatch, block):
    """A third of the rows in one group of near copies, in one block and in many; chains; copies of one vector."""
    monkeypatch.setattr(pivots, "BLOCK", block)
    rows = clusters(1, [1] * 150 + [2] * 20 + [5] * 10 + [130], 0.12)
    chain = [(1000 + i, [math.cos(0.15 * i), math.sin(0.15 * i)] + [0.0] * 30, 7) for i in range(12)]
    copies = [(2000 + i, rows[0][1], rows[0][2]) for i in range(40)]
    assert result(spark, rows + chain + copies) == brute(rows + chain + copies)


def test_recall_on_many_vectors(spark):
    rows = clusters(2, [1] * 1500 + [2] * 300 + [4] * 100 + [300], 0.14, width=64, labels=4)
    expected = {r[0]: r[1] for r in brute(rows)}
    found = {r[0]: r[1] for r in result(spark, rows)}
    assert all(found[i] <= n for i, n in expected.items())
    assert sum(found.values()) >= 0.99 * sum(expected.values()) > 0


def test_edge_rows(spark):
    v, w = [1.0, 2.0, 3.0], [1.0, 2.0, 3.1]
    rows = [
        (1, v, 0), (2, v, 0), (2, v, 0), (3, w, 0), (None, w, 0), (4, v, None), (5, v, 1), (6, None, 0), (7, [0.0, 0.0, 0.0], 0), (8, [1.0, None, 3.0], 0), (9, [1.0, NAN, 3.0], 0),
        (10, [float("inf"), 0.0, 0.0], 0), (11, [], 0), (12, [1.0, 2.0, 3.0, 0.0], 0), (13, [10.0, 20.0, 30.0], 0), (14, [1e-200, 2e-200, 3e-200], 0), (15, [-1.0, -2.0, -3.0], 0),
        (None, [5.0, 0.0, 0.0], 4), (None, [5.0, 0.0, 0.0], 4), (3, [0.0, 0.0, 1.0], 0), (16, [1.0], 5), (17, [2.0], 5), (18, [-0.0, 1.0], 6), (19, [0.0, 1.0], 6),
    ]
    large = [(i, [x * 1e200 if x and abs(x) < 1 else x for x in v] if i == 14 and v else v, label) for i, v, label in rows]
    assert result(spark, rows) == brute(large)
    assert result(spark, rows[:1]) == [("1", 0, "1", True)]
    assert pivots.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_matches_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    entry = REGISTRY["op13_near_vectors"]
    assert compare(spark, duck(sf_dir), entry.run, entry.sql, sf_dir)[0] == ""
