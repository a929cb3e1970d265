import json

import pytest
from pyspark.sql import functions as F

from tablewright.corpus import Corpus, type_rows
from tablewright.operators import prep, scoring
from tablewright.operators.sketch import answer_sketches
from tablewright.sources import datasets
from tablewright.streaming import incremental


def test_lines_are_numbered_across_pieces(spark, tmp_path):
    for name, offset in (("q.src", 0), ("a.tgt", 10_000)):
        (tmp_path / name).write_text("".join(f" {i + offset}  \n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        pairs = datasets.read_line_pairs(spark, str(tmp_path / "q.src"), str(tmp_path / "a.tgt"))
        got = sorted((r["line_no"], r["question"], r["answer"]) for r in pairs.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(i, str(i), str(i + 10_000)) for i in range(3000)]


def test_questions_and_tables_from_json_lines(spark, tmp_path):
    table = {"id": "t1", "header": ["n", "w"], "types": ["real", "text"], "rows": [[5, "a b"], [2.5, "c"]]}
    question = {"table_id": "t1", "question": "How many?", "sql": {"sel": 0, "agg": 4, "conds": [[1, 0, "A b"]]}}
    (tmp_path / "t.jsonl").write_text(json.dumps(table) + "\n")
    listed = question | {"sql": {"sel": 0, "agg": 4, "conds": {"column_index": [1], "operator_index": [0], "condition": ["A b"]}}}
    (tmp_path / "q.jsonl").write_text(json.dumps(question) + "\n" + json.dumps(listed) + "\n")
    rows, meta = datasets.read_tables(spark, str(tmp_path / "t.jsonl"))
    corpus = Corpus(type_rows(rows, meta), meta)
    examples = datasets.read_questions(spark, str(tmp_path / "q.jsonl"))
    assert sorted((r["example_id"], r["answer"]) for r in answer_sketches(examples, corpus).collect()) == [(0, "5.0"), (1, "5.0")]


def test_array_csv_and_tagged_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"nt": "1"},\n {"nt": "2"}]')
    assert datasets.read_json_array(spark, str(tmp_path / "a.json"), "nt string").count() == 2
    (tmp_path / "train.csv").write_text('question,answer\n"a, ""b""\nc",2\n')
    got = datasets.read_split(spark, str(tmp_path / "train.csv"), "train", multi_line=True).first()
    assert got.asDict() == {"question": 'a, "b"\nc', "answer": "2", "split": "train"}
    with pytest.raises(ValueError):
        datasets.read_split(spark, "x.txt", "train")
    (tmp_path / "t.tagged").write_text('id\ttargetValue\ttargetCanon\nnt-0\ta\\pb|"c\\nd\t1|2\n')
    row = datasets.read_tagged_answers(spark, str(tmp_path / "t.tagged")).first()
    assert row["values"] == ["a|b", '"c\nd'] and row["canonical"] == ["1", "2"]


def test_sinks(spark, tmp_path):
    predictions = spark.createDataFrame([(" x ", "y")], "pred string, ref string")
    datasets.write_prediction_lines(predictions, str(tmp_path / "lines"))
    datasets.write_predictions(predictions, str(tmp_path / "preds"))
    assert spark.read.text(str(tmp_path / "lines")).first()["value"] == "pred:  x  ref: y"
    assert spark.read.text(str(tmp_path / "preds")).first()["value"] == "x"
    datasets.write_dataset(predictions, str(tmp_path / "set"))
    assert datasets.read_dataset(spark, str(tmp_path / "set")).collect() == predictions.collect()
    datasets.write_metrics(spark.createDataFrame([("7", 0.5)], "checkpoint string, accuracy double"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first()["accuracy"] == 0.5


def test_conversion_goes_on_where_it_stopped(spark, tmp_path):
    lines = spark.range(25).select(F.col("id").alias("line_no"), F.col("id").cast("string").alias("line"))
    out = str(tmp_path / "chunks")
    first = prep.convert_chunks(lines, lambda df: df.withColumn("run", F.lit(1)), out, chunk_rows=10, end_chunk=1)
    assert first.count() == 10
    done = prep.convert_chunks(lines, lambda df: df.withColumn("run", F.lit(2)), out, chunk_rows=10)
    got = {(r["chunk_id"], r["run"]): r["n"] for r in done.groupBy("chunk_id", "run").agg(F.count("*").alias("n")).collect()}
    assert got == {(0, 1): 10, (1, 2): 10, (2, 2): 5}


def test_splits(spark):
    ids = spark.range(2000).withColumnRenamed("id", "i")
    split = prep.ensure_splits(ids, "i", 3)
    counts = {r["split"]: r["n"] for r in split.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert abs(counts["train"] - 1200) < 100 and abs(counts["test"] - 400) < 80
    again = prep.ensure_splits(ids.repartition(17), "i", 3)
    assert split.join(again, ["i", "split"]).count() == 2000
    assert prep.ensure_splits(split, "i", 99).exceptAll(split).isEmpty()


def test_arriving_files_convert_once(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "i long"

    def run():
        stream = incremental.arriving_files(spark, source, spark.range(0).toDF("i").schema, "*.parquet", files_per_batch=1)
        incremental.convert_arriving(stream, lambda df: df.withColumn("j", F.col("i") * 2), out, state).awaitTermination()
        return sorted(r["j"] for r in spark.read.parquet(out).collect())

    spark.range(3).toDF("i").coalesce(1).write.mode("append").parquet(source)
    assert schema and run() == [0, 2, 4]
    spark.range(3, 5).toDF("i").coalesce(1).write.mode("append").parquet(source)
    assert run() == [0, 2, 4, 6, 8]


def test_running_scores_follow_arrivals(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "checkpoint string, pred string, ref string"

    def arrive(rows):
        batch = spark.createDataFrame(rows, schema)
        batch.coalesce(1).write.mode("append").parquet(source)
        stream = incremental.arriving_files(spark, source, batch.schema, "*.parquet")
        incremental.running_scores(stream, ["checkpoint"], out, state).awaitTermination()
        seen.extend(rows)
        whole = scoring.summarize(spark.createDataFrame(seen, schema), ["checkpoint"])
        got = {r["checkpoint"]: tuple(r) for r in incremental.latest_scores(spark, out, ["checkpoint"]).select(whole.columns).collect()}
        assert got == {r["checkpoint"]: tuple(r) for r in whole.collect()}
        return {k: v[1:3] for k, v in got.items()}

    seen = []
    assert arrive([("1", "a", "a"), ("2", "b", "c")]) == {"1": (1, 1.0), "2": (1, 0.0)}
    assert arrive([("2", "c", "c")]) == {"1": (1, 1.0), "2": (2, 0.5)}
    # Missing answers count as empty text; of equally frequent distances the lowest is the mode.
    assert arrive([("2", None, "abcd"), ("2", "ab", None), ("2", None, None), ("3", None, "xy"), (None, "a", "b")])["2"] == (5, 0.4)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def chunks_now(df):
    return sorted((r["line_no"], r["line"]) for r in df.collect())


def test_chunks_that_change_are_replaced_whole(spark, tmp_path):
    out, converted = str(tmp_path / "chunks"), []

    def run(lines, **limits):
        def convert(todo):
            converted.append({r["chunk_id"] for r in todo.select("chunk_id").distinct().collect()})
            return todo.where("line <> 'bad'")

        df = spark.createDataFrame(lines, "line_no long, line string")
        return chunks_now(prep.convert_chunks(df, convert, out, chunk_rows=50, **limits))

    first = [(i, "c") for i in range(130)]
    assert run(first) == first and converted[-1] == {0, 1, 2}
    assert run(first[::-1]) == first and converted[-1] == set()
    grown = first + [(i, "b") for i in range(130, 160)]
    assert run(grown) == grown and converted[-1] == {2, 3}
    assert run(first) == first and converted[-1] == {2}  # shrunk again: no stale lines, and chunk 3 is gone
    edited = [(i, "e" if i == 7 else t) for i, t in first]
    assert run(edited) == edited and converted[-1] == {0}
    moved = [(i, "e" if i == 8 else t) for i, t in first]
    assert run(moved) == moved and converted[-1] == {0}
    failing = [(i, "bad" if i < 50 else t) for i, t in first]
    assert run(failing) == failing[50:] and converted[-1] == {0}
    assert run(failing) == failing[50:] and converted[-1] == set()  # a chunk without results is not tried again
    assert run(edited, start_chunk=1) == failing[50:] and converted[-1] == set()
    assert run([], end_chunk=2) == first[100:] and run([]) == []


def test_a_run_that_failed_can_be_repeated(spark, tmp_path):
    out = str(tmp_path / "chunks")
    lines = spark.createDataFrame([(i, str(i)) for i in range(30)], "line_no long, line string")
    prep.convert_chunks(lines, lambda df: df, out, chunk_rows=10)
    changed = lines.withColumn("line", F.concat("line", F.lit("x")))

    def failing(df):
        return df.withColumn("line", F.when(F.col("line_no") == 25, F.raise_error(F.lit("no"))).otherwise(F.col("line")))

    with pytest.raises(Exception, match="no"):
        prep.convert_chunks(changed, failing, out, chunk_rows=10).count()
    done = prep.convert_chunks(changed, lambda df: df, out, chunk_rows=10)
    assert chunks_now(done) == [(i, f"{i}x") for i in range(30)]
