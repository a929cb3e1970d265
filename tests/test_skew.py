from pyspark.sql import functions as F

from tablewright import skew
from tablewright.operators import relational as rel
from tablewright.operators.linear import delinearize, linearize
from tablewright.skew import has_larger_group, row_positions
from tablewright.sources.driver_tables import LINE_ORDER, order_corpus, table

SF_DIR = "/root/testdata/sf0.001"


def numbered(df, keys):
    return sorted(tuple(str(v) for v in row) for row in df.select(*keys, "l_linenumber", "l_partkey", "row_pos").collect())


def test_hot_groups_are_numbered_as_others(spark):
    lines = table(spark, SF_DIR, "lineitem").withColumn("hot", (F.col("l_orderkey") > 500).cast("int"))
    for keys in (["hot"], ["l_returnflag", "hot"]):
        plain = row_positions(lines, keys, ["l_orderkey", *LINE_ORDER])
        spread = row_positions(lines, keys, ["l_orderkey", *LINE_ORDER], hot_rows=10)
        assert numbered(plain, keys) == numbered(spread, keys)


def test_numbers_without_keys_are_dense_even_for_copies(spark):
    copies = spark.range(5000).select(F.lit(7).alias("v"), (F.col("id") % 3).cast("int").alias("w"))
    got = [(r["w"], r["n"]) for r in row_positions(copies, [], ["v", "w"], "n").collect()]
    assert sorted(n for _, n in got) == list(range(1, 5001))
    assert [w for w, _ in sorted(got, key=lambda x: x[1])] == sorted(w for w, _ in got)


def test_missing_keys_and_descending_order(spark):
    df = spark.createDataFrame([(None, 1), (None, 3), (1, 2), (1, None)], "k int, v int")
    for hot in (100, 0):
        got = {(r["k"], r["v"]): r["n"] for r in row_positions(df, ["k"], ["-v"], "n", hot_rows=hot).collect()}
        assert got == {(None, 3): 1, (None, 1): 2, (1, 2): 1, (1, None): 2}


def test_segments_join_to_the_whole_text_and_read_back(spark):
    corpus = order_corpus(spark, SF_DIR)
    whole = {r["table_id"]: r["linear_text"] for r in linearize(corpus.rows, corpus.meta).collect()}
    pieces = linearize(corpus.rows, corpus.meta, block_rows=2).cache()
    joined = {}
    for r in pieces.orderBy("table_id", "segment").collect():
        joined[r["table_id"]] = joined.get(r["table_id"], "") + r["linear_text"]
    assert joined == whole
    rows, _, bad = delinearize(pieces)
    assert rows.count() == corpus.rows.count() and bad.where("problem <> 'no rows'").count() == 0


def test_group_lists_blocks_hold_everything(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("k"), F.when(F.col("id") % 5 != 0, F.col("id")).alias("v"), "id")
    got = rel.group_lists(df, ["k"], "v", ["id"], block_rows=7).orderBy("k", "block").collect()
    assert max(len(r["values"]) for r in got) == 7
    for key in (0, 1):
        flat = [v for r in got if r["k"] == key for v in r["values"]]
        assert flat == [i if i % 5 else None for i in range(key, 100, 2)]


def test_larger_groups_are_found_by_buckets(spark, monkeypatch):
    df = spark.createDataFrame([(i % 50 or None, i) for i in range(1000)] + [(7, i) for i in range(5)], "k int, v int")
    for buckets in (1, 65_536):
        monkeypatch.setattr(skew, "BUCKETS", buckets)
        assert [has_larger_group(df, ["k"], n) for n in (0, 19, 24, 25, 2000)] == [True, True, True, False, False]
    # Where no bucket holds more, groups are not counted one by one.
    counted = []
    monkeypatch.setattr(skew, "largest_group", lambda df, keys: counted.append(keys) or 5)
    assert not has_larger_group(df, ["k"], 5) and counted == [["bucket"]]
    assert not has_larger_group(df.limit(0), ["k"], 5)
