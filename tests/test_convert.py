import re

import pytest
from pyspark.sql import functions as F

from tablewright.corpus import Corpus, type_rows
from tablewright.operators.convert import convert_sketches
from tablewright.queries.conversions import convert_order_sketches

EXAMPLE = "example_id long, table_id long, sel int, agg int, conds array<struct<col:int,op:int,value:string>>"
META = "table_id long, header array<string>, types array<string>"


def converted(spark, queries=None):
    """Table 1 has two rows, 2 none, 3 no description in words, 4 rows only; an example of 1 comes twice, one fails, one has no id."""
    raw = spark.createDataFrame([(1, 1, ["5", "x"]), (1, 2, ["6", "y"]), (3, 1, ["7", "z"]), (4, 1, ["8", "w"]), (None, 1, ["9", "n"])], "table_id long, row_pos long, cells array<string>")
    meta = spark.createDataFrame([(t, ["a", "b"], ["real", "text"]) for t in (1, 2, 3, None)], META)
    rows = type_rows(raw, meta).unionByName(raw.where("table_id = 4 OR table_id IS NULL").withColumn("cells", F.transform("cells", lambda c: F.struct(c.alias("raw"), F.lit(None).cast("double").alias("num")))))
    natural = spark.createDataFrame([(t, ["first", "second"], ["real", "text"]) for t in (1, 2, None)], META)
    examples = [(10, 1, 1, 0, []), (10, 1, 1, 0, []), (11, 1, 0, 3, []), (12, 1, 0, 0, [(0, 0, "many")]), (13, 2, 1, 0, []), (14, 3, 0, 0, []), (15, 4, 1, 0, []), (None, 1, 0, 0, [(0, 0, "many")]), (16, None, 0, 0, [])]
    return convert_sketches(spark.createDataFrame(examples, EXAMPLE), Corpus(rows, meta), natural, queries)


def test_texts_of_both_headers(spark):
    got = converted(spark)
    assert got.columns == ["table_id", "example_id", "segment", "query_text", "answer", "linear_text", "natural_text", "status"]
    texts = {(r["table_id"], r["example_id"], r["segment"]): (r["linear_text"], r["natural_text"], r["status"]) for r in got.collect()}
    body = " row 1 : 5 | x row 2 : 6 | y"
    both = (" col : a | b" + body, " col : first | second" + body)
    assert texts[1, 10, 0] == texts[1, 11, 0] == (*both, "ok") and texts[1, 12, 0] == (*both, "type_error")
    assert texts[2, 13, 0] == (" col : a | b", " col : first | second", "ok")
    assert texts[3, 14, 0] == (" col : a | b row 1 : 7 | z", " row 1 : 7 | z", "ok")
    assert texts[4, 15, 0] == (" row 1 : 8 | w", " row 1 : 8 | w", "ok")
    assert got.where("example_id = 10").count() == 4 and got.where("example_id = 16 AND linear_text IS NOT NULL").count() == 0


def test_rows_are_printed_once(spark):
    plan = converted(spark)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(piece") == 1


def test_queries_may_be_given(spark):
    queries = spark.createDataFrame([(10, "ten"), (12, "twelve"), (99, "none")], "example_id long, query_text string")
    got = {(r["example_id"], r["query_text"], r["linear_text"] is not None) for r in converted(spark, queries).collect()}
    assert got == {(10, "ten", True), (12, "twelve", True)}


def test_printed_rows_stay_where_the_table_lies(spark):
    got = convert_order_sketches(spark, "/root/testdata/sf0.001")
    assert got.collect()
    final = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    dealt = re.findall(r"hashpartitioning\((.*)", final)
    assert dealt and not any(re.search(r"segment|probe_col", x) for x in dealt)


@pytest.mark.parametrize("placed_rows", [9000, 8999])
def test_long_tables_go_on_in_segments(spark, placed_rows):
    cell = lambda n: F.struct(n.cast("string").alias("raw"), n.cast("double").alias("num"))
    rows = spark.range(1, 9001).select(F.lit(1).cast("long").alias("table_id"), F.col("id").alias("row_pos"), F.array(cell(F.col("id"))).alias("cells"))
    meta = spark.createDataFrame([(1, ["a"], ["real"])], META)
    examples = spark.createDataFrame([(10, 1, 0, 0, []), (10, 1, 0, 0, []), (11, 1, 0, 3, []), (12, 1, 0, 0, [(0, 1, "8999")])], EXAMPLE)
    got = convert_sketches(examples, Corpus(rows, meta), meta, placed_rows=placed_rows).orderBy("example_id", "segment").collect()
    # An example that comes twice meets its answers, and there are two of each.
    assert [(r["example_id"], r["segment"]) for r in got] == [(10, s) for s in (0, 1, 2) for _ in range(4)] + [(e, s) for e in (11, 12) for s in (0, 1, 2)]
    assert ", ".join(r["answer"] for r in got[:12:4]) == ", ".join(map(str, range(1, 9001)))
    assert [r["answer"] for r in got[12:]] == ["9000.0", None, None, "9000.0", None, None]
    texts = ["".join(r["linear_text"] for r in got if r["example_id"] == e) for e in (11, 12)]
    assert texts == [" col : a" + "".join(f" row {i} : {i}" for i in range(1, 9001))] * 2
