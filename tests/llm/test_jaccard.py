"""The n-gram join against all pairs of texts, in every kind of round; the components; edge rows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tablewright.llm import common, jaccard
from tablewright.llm.components import components
from tablewright.llm.queries import op4_ngram_jaccard
from tests.llm.test_pipeline import groups, shingles


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    first, sets = groups(rows)
    return sorted((str(i), len(s), str(rows[first[k]][0])) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


def near_copies(seed, bases, copies, words):
    rng = random.Random(seed)
    rows = []
    for _ in range(bases):
        base = [rng.choice("abcdefghij") + str(rng.randrange(60)) for _ in range(words)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randrange(0, max(1, words // 25))):
                own[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(own))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("most", [0, 4, 10**9])
def test_all_links_are_found(spark, monkeypatch, most):
    """Rounds by first class only, mixed, and all pairs at once give the same groups."""
    monkeypatch.setattr(jaccard, "PAIRS_PER_POSTING", most)
    rows = near_copies(1, 6, 12, 80) + [(1000 + i, t) for i, t in near_copies(2, 3, 10, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.similar_documents(docs).collect()) == brute(rows)


def test_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE  two "), (8, "a b c"), (9, "a b c"), (9, "a b c"), (10, long), (11, long + " end"), (12, "É b"), (13, "é b"), (14, "a b c d"), (15, "x x x x x x x x x x x x x"), (16, "x x x")]
    docs = spark.createDataFrame([(*r, 5, "k") for r in rows], "doc_id long, text string, n int, key string")
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.similar_documents(docs).collect()) == brute(rows)
    assert jaccard.similar_documents(docs.where("false")).count() == 0


def test_query_on_the_test_data(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in op4_ngram_jaccard(spark, sf_dir).collect()) == brute(rows)


def test_sets_match_plain_shingles():
    texts = ["a b c d", "a b", "", None, "A\x0bB c a b c", "ß É é"]
    assert [len(s) for s in jaccard.shingle_sets(pa.array(texts, pa.string()))] == [len(shingles(t)) for t in texts]


def test_partner_filter_keeps_all_that_could_pair():
    rng = np.random.default_rng(0)
    sizes = np.array([2, 3, 2, 7])
    n = rng.integers(10, 14, sizes.sum())
    pos = rng.integers(0, 2, sizes.sum())
    able = jaccard._has_partner(sizes, n, pos)
    ends = np.cumsum(sizes)
    for lo, hi in zip(ends - sizes, ends, strict=True):
        for i in range(lo, hi):
            want = any(i != j and min(n[i], n[j]) * 10 >= max(n[i], n[j]) * 9 and min(n[i] - pos[i], n[j] - pos[j]) >= jaccard.needed(int(n[i]), int(n[j])) for j in range(lo, hi))
            assert able[i] == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(30, 25), (25, 40), (50, 50), (61, 60), (60, 61)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(21), 0), 25: 25, 30: 25, 40: 25, 60: 60, 61: 60}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_pairs_between_the_thresholds(spark):
    """Near copies at 80 % of 5-shingles that are none at 90 % of 3-shingles, and pairs just below."""
    base = [f"w{i}" for i in range(200)]
    swapped = lambda at: " ".join("changed" + str(i) if i in at else w for i, w in enumerate(base))
    texts = [swapped(()), swapped((30, 70, 110, 150)), " ".join([*base, *(f"more{i}" for i in range(30))]), " ".join([*base, *(f"extra{i}" for i in range(60))]), swapped((10, 50, 90, 130, 170))]
    docs = spark.createDataFrame([(*r, "s") for r in enumerate(texts)], "doc_id long, text string, source string")
    of = lambda found: {r.doc_id: r.component_id for r in found.collect()}
    assert of(jaccard.similar_documents(docs)) == {i: i for i in range(5)}
    assert of(jaccard.similar_documents(docs, 5, 80)) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}
    from corpus_pipeline import copies_stage

    assert sorted(r.doc_id for r in copies_stage(spark, docs, "").collect()) == [0, 3, 4]


@pytest.mark.parametrize("most", [0, 4, 10**9])
def test_all_links_are_found_at_other_thresholds(spark, monkeypatch, most):
    monkeypatch.setattr(jaccard, "PAIRS_PER_POSTING", most)
    rows = near_copies(3, 6, 12, 80)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.component_id for r in jaccard.similar_documents(docs, 5, 80).orderBy("doc_id").collect()] == root


def test_a_centre_of_many_pairs_is_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PAIRS_AT_ONCE", 4)
    rows = near_copies(5, 1, 40, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.similar_documents(docs).collect()) == brute(rows)


def test_join_of_hot_keys(spark, monkeypatch):
    """Hot, rare, unknown and missing keys, and no rows at all, against a plain left join."""
    monkeypatch.setattr(common, "HOT_KEYS", 4)
    rows = spark.createDataFrame([(i, "hot" if i % 2 else None if i % 3 else f"k{i}") for i in range(60)], "i int, key string")
    of_key = spark.createDataFrame([("hot", 1), *((f"k{i}", i) for i in range(0, 60, 12))], "key string, v int")
    plain = lambda df: sorted(map(str, df.select("i", "key", "v").collect()))
    assert plain(common.join_hot(rows, of_key, "key")) == plain(rows.join(of_key, "key", "left"))
    assert plain(common.join_hot(rows.where("false"), of_key, "key")) == []
