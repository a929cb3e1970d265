from pyspark.sql import functions as F

from tablewright.operators import relational as rel


def test_lists_with_missing_entries(spark):
    df = spark.sql("SELECT array(1, NULL) AS a, array(1, 1) AS b, array(NULL) AS c")
    got = df.select(
        rel.all_compare(F.col("a"), ">", 0).alias("all_positive"),
        rel.any_equal(F.col("a"), 1).alias("any_one"),
        rel.any_differs(F.col("a"), 1).alias("a_differs"),
        rel.any_differs(F.col("b"), 1).alias("b_differs"),
        rel.any_in(F.col("a"), [1, 5]).alias("any_in"),
        rel.list_intersect(F.col("b"), F.col("a")).alias("both"),
        rel.list_intersect(F.col("a"), F.col("a")).alias("itself"),
    ).first()
    assert tuple(got) == (False, True, True, False, True, [1, 1], [1, None])


def test_none_literal_prefers_rows_that_say_none(spark):
    df = spark.createDataFrame([(1, "none"), (2, None), (3, "x")], "i int, s string")
    assert [r["i"] for r in rel.equals_literal(df, "s", "none").collect()] == [1]
    assert [r["i"] for r in rel.equals_literal(df.where("i > 1"), "s", "none").collect()] == [2]


def test_group_verdicts_equal_list_verdicts(spark):
    df = spark.range(60).select((F.col("id") % 7).alias("k"), F.when(F.col("id") % 4 != 0, F.col("id") % 5).alias("v"), "id")
    v = F.col("v")
    rows = rel.group_verdicts(df, ["k"], any=rel.any_row(v == 1), all=rel.all_rows(v < 4)).orderBy("k").collect()
    lists = rel.group_lists(df, ["k"], "v", ["id"]).orderBy("k")
    listed = lists.select("k", rel.any_equal(F.col("values"), 1), rel.all_compare(F.col("values"), "<", 4)).collect()
    assert [tuple(r) for r in rows] == [tuple(r) for r in listed]


def test_missing_matches_missing_in_intersection(spark):
    left = spark.createDataFrame([(1,), (1,), (None,), (2,)], "v int")
    right = spark.createDataFrame([(1,), (None,)], "v int")
    assert sorted(str(r["v"]) for r in rel.bag_intersect(left, right, "v").collect()) == ["1", "1", "None"]


def test_descending_ties_are_reversed(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (4, None)], "i int, v int")
    got = rel.ordered(df, "i", "v", ["i"], descending=True).orderBy("rank").collect()
    assert [r["i"] for r in got] == [3, 2, 1]


def test_having_honours_or_and_ignores_unknown(spark):
    df = spark.createDataFrame([(1, 5, None), (2, 1, True), (3, 1, None)], "k int, n int, b boolean")
    assert [r["k"] for r in rel.having(df, F.col("n") > 3, F.col("b"), either=True).orderBy("k").collect()] == [1, 2]
    assert rel.having(df, F.col("n") > 0, F.col("b")).count() == 1


def test_collapse(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (2, 1, "a"), (2, 2, None), (3, 1, None), (3, 2, None)], "k int, p int, v string")
    got = [(r["k"], r["p"]) for r in rel.collapse_groups(df, ["k"], "v", "p").orderBy("k", "p").collect()]
    assert got == [(1, 1), (2, 1), (2, 2), (3, 1)]


def test_empty_sides_count_as_zero(spark):
    df = spark.createDataFrame([(5.0,)], "v double")
    gap = rel.one_value(df, F.max("v")) - rel.one_value(df.where("v > 9"), F.max("v"))
    assert spark.range(1).select(gap.alias("g")).first()["g"] == 5.0


def test_text_arithmetic_and_totals(spark):
    df = spark.createDataFrame([("5", "2"), ("x", "2"), ("6", "0"), (None, "1")], "a string, b string")
    difference, quotient = (rel.text_arithmetic(F.col("a"), op, F.col("b")) for op in "-/")
    got = df.select(difference.alias("d"), quotient.alias("q")).collect()
    assert [tuple(r) for r in got] == [(3.0, 2.5), (None, None), (6.0, None), (None, None)]
    assert df.agg(rel.text_total(F.col("a")).alias("t")).first()["t"] == 11.0
    assert df.where("a = 'x'").agg(rel.text_total(F.col("a")).alias("t")).first()["t"] == 0.0
    assert [r["b"] for r in rel.distinct_values(df, "b").orderBy("b").collect()] == ["0", "1", "2"]


def test_distinct_counts_merge_over_parts(spark):
    rows = spark.range(40_000).select((F.col("id") % 3).alias("k"), (F.col("id") % 7).alias("part"), F.when(F.col("id") % 10 > 0, F.col("id") % 9001).alias("v"))
    rows = rows.unionByName(spark.sql("SELECT 9L AS k, 0L AS part, CAST(NULL AS BIGINT) AS v"))
    exact = {r["k"]: (r["n"], r["d"]) for r in rows.groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("v").alias("d")).collect()}
    for value in ("v", "text"):
        df = rows.withColumn("text", F.col("v").cast("string"))
        merged = rel.merge_distinct(rel.distinct_sketches(df, ["k", "part"], value), ["k"])
        for r in merged.collect():
            n, distinct = exact[r["k"]]
            assert r["n_rows"] == n and abs(r["n_distinct"] - distinct) <= 0.033 * distinct
