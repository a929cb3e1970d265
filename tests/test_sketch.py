from collections import defaultdict

import pytest

from tablewright.corpus import Corpus, type_rows
from tablewright.operators import sketch
from tablewright.operators.sketch import answer_sketches
from tablewright.sources.driver_tables import order_corpus, order_sketches

EXAMPLE = "example_id long, table_id long, sel int, agg int, conds array<struct<col:int,op:int,value:string>>"
ROWS = [["5", "Old Town", "1"], ["5", "new-town", "2"], ["3", "New Town", "x9"], ["1,000", "old town", "4"]]


@pytest.fixture(scope="module")
def corpus(spark):
    raw = spark.createDataFrame(
        [(1, i + 1, cells) for i, cells in enumerate(ROWS)] + [(2, 1, ["n/a", "x", "y"])],
        "table_id long, row_pos long, cells array<string>",
    )
    meta = spark.createDataFrame(
        [(t, ["a", "b", "c"], ["real", "text", "text"]) for t in (1, 2, 3)],
        "table_id long, header array<string>, types array<string>",
    )
    return Corpus(type_rows(raw, meta), meta)


def answers(spark, corpus, *examples, **limits):
    df = spark.createDataFrame([(i, *e) for i, e in enumerate(examples)], EXAMPLE)
    got = answer_sketches(df, corpus, **limits).orderBy("example_id", "segment").collect()
    whole = defaultdict(list)
    for row in got:
        whole[row["example_id"]].append(row["answer"] if row["status"] == "ok" else row["status"])
    return [", ".join(whole[i]) for i in range(len(examples))]


CASES = [
    ((1, 0, 0, []), "5, 5, 3, 1,000"),
    ((1, 0, 1, [(0, 2, "100")]), "5.0"),  # a tie: the value of the last of the largest
    ((1, 0, 2, []), "3.0"),
    ((1, 2, 1, [(0, 0, "5")]), "2.0"),  # a single text cell that reads as a number prints as one
    ((1, 1, 1, []), "old town"),  # text extremes compare the text itself
    ((1, 1, 0, [(1, 0, "NEW town")]), "New Town"),  # equality goes by lower-cased words
    ((1, 1, 0, [(1, 0, "new - town")]), "new-town"),
    ((1, 1, 0, [(1, 1, "new town")]), "Old Town, old town"),
    ((1, 0, 3, [(0, 1, "3.5")]), "3.0"),
    ((1, 0, 3, [(0, 1, "1e9")]), "0.0"),
    ((1, 0, 4, [(0, 1, "1e9")]), "none"),
    ((1, 0, 4, []), "1013.0"),
    ((1, 0, 5, [(0, 2, "100")]), str(13 / 3)),
    ((1, 1, 4, [(0, 0, "5")]), "Old Town, new-town"),  # a sum of words falls back to the cells
    ((1, 1, 4, [(0, 0, "3")]), "type_error"),  # a single word cannot be summed
    ((1, 0, 0, [(0, 0, "many")]), "type_error"),
    ((2, 0, 0, []), "type_error"),  # a number column holds a word
    ((3, 0, 3, []), "0.0"),
    ((3, 0, 1, []), "none"),
]


@pytest.mark.parametrize("limits", [{}, {"block_rows": 2}, {"block_rows": 1}])
def test_answers_by_every_route(spark, corpus, limits):
    got = answers(spark, corpus, *[c for c, _ in CASES], **limits)
    assert got == [a for _, a in CASES]


@pytest.mark.parametrize("limits", [{}, {"block_rows": 2}, {"hot_rows": 0, "block_rows": 1}])
@pytest.mark.parametrize("few", [0, 100])
def test_answers_of_tables_asked_seldom_and_often(spark, corpus, monkeypatch, few, limits):
    monkeypatch.setattr(sketch, "FEW_EXAMPLES", few)
    got = answers(spark, corpus, *[c for c, _ in CASES] * 2, **limits)
    assert got == [a for _, a in CASES] * 2


def test_described_twice_by_every_route(spark, corpus):
    """A table that is described twice meets its rows twice, however it is answered."""
    twice = Corpus(corpus.rows, corpus.meta.union(corpus.meta))
    asked = [(1, 0, 3, []), (1, 0, 3, [(1, 0, "old town")]), (1, 0, 3, []), (3, 0, 3, []), (2, 1, 0, [])]
    expected = ["8.0", "4.0", "8.0", "0.0", "x, x"]
    assert [answers(spark, twice, *asked, hot_rows=n) for n in (1000, 0)] == [expected] * 2


def test_rows_of_seldom_asked_tables_stay(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = answer_sketches(order_sketches(spark, sf_dir), order_corpus(spark, sf_dir))
    assert got.collect()
    final = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "l_orderkey" in final and "probe_col" not in final


def test_ties_pick_first_minimum_and_last_maximum(spark):
    rows = spark.createDataFrame(
        [(1, 1, [("5.0", 5.0)]), (1, 2, [("5", 5.0)])], "table_id long, row_pos long, cells array<struct<raw:string,num:double>>"
    )
    words = spark.createDataFrame(
        [(2, 1, [("b", None)]), (2, 2, [("b", None)])], "table_id long, row_pos long, cells array<struct<raw:string,num:double>>"
    )
    meta = spark.createDataFrame([(1, ["a"], ["real"]), (2, ["a"], ["text"])], "table_id long, header array<string>, types array<string>")
    corpus = Corpus(rows.unionByName(words), meta)
    assert answers(spark, corpus, (1, 0, 1, []), (1, 0, 2, []), (2, 0, 1, [])) == ["5.0", "5.0", "b"]


def test_same_answers_on_any_partitioning_and_in_blocks(spark):
    sf_dir = "/root/testdata/sf0.001"
    corpus, examples = order_corpus(spark, sf_dir), order_sketches(spark, sf_dir)
    plain = {r["example_id"]: r["answer"] for r in answer_sketches(examples, corpus).collect()}
    for n in (1, 64):
        again = answer_sketches(examples.repartition(n), corpus).collect()
        assert {r["example_id"]: r["answer"] for r in again} == plain
    blocks = defaultdict(list)
    for r in answer_sketches(examples, corpus, block_rows=3).orderBy("segment").collect():
        blocks[r["example_id"]].append(r["answer"])
    assert {k: ", ".join(v) for k, v in blocks.items()} == plain
