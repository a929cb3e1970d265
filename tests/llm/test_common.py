"""Memory that the stages of the pipeline take, in Python and in Parquet's readers and writers."""

import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tablewright.llm import common, decontaminate
from tablewright.llm import language as lg


def python_steps(plan: str) -> int:
    """The most Python operators on one path between exchanges and scans, as the lines of a formatted tree tell."""
    most, open_at = 0, []
    for line in plan.split("\n"):
        depth = len(line) - len(line.lstrip(" :+-"))
        open_at = [(d, n) for d, n in open_at if d < depth]
        now = 0 if "Exchange" in line else (open_at[-1][1] if open_at else 0) + ("InArrow" in line)
        open_at.append((depth, now))
        most = max(most, now)
    return most


def test_a_task_of_cut_spans_has_one_python_step(spark):
    docs = spark.createDataFrame([(1, "Keep this. A b, C! and that"), (2, "none")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "A b c")], "item_id long, text string")
    cut = decontaminate.cut_spans(docs, decontaminate.windows(items))
    assert python_steps(cut._jdf.queryExecution().executedPlan().toString()) == 1
    assert sorted(r.text for r in cut.collect()) == ["Keep this. ! and that", "none"]


def test_models_and_windows_start_no_rdd_workers(spark, monkeypatch):
    """Rows that the driver makes are handed over as Arrow, so no RDD of a Python list is made."""
    docs = spark.createDataFrame([(i, "the thing that is", "en") for i in range(9)], "doc_id long, text string, lang string")
    items = spark.createDataFrame([(1, "thing that")], "item_id long, text string")
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", None)
    assert lg.learn(docs).langs == ["en"] and lg.learn(docs.where("false")).langs == []
    found = decontaminate.find_spans(docs, decontaminate.windows(items))
    assert found.where("size(spans) = 1").count() == 9


def test_language_of_a_step_takes_bounded_memory():
    """Beside what each character takes, the scores of letters in all languages are not held at once."""
    langs = [f"l{i:02}" for i in range(40)]
    model = lg.Model(langs, np.random.default_rng(0).random((2**lg.TRIGRAM_BITS, 40), dtype=np.float32), np.ones((len(lg.SCRIPTS) + 2, 40), dtype=bool))
    texts = pa.array(["abcdefghij " * 10_000] * 10)
    lg.identify(pa.array(["a"]), model)
    tracemalloc.start()
    lg.identify(texts, model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6, peak


def test_scratch_tables_of_large_rows_have_bounded_row_groups(spark):
    """Rows of 1 MB, of which 100 would be one page of one row group."""
    noise = np.random.default_rng(0)
    values = pa.table({"id": [i if i % 7 else None for i in range(30)], "data": pa.array([noise.bytes(1 << 20) if i % 5 else None for i in range(30)], pa.binary())})
    rows = spark.createDataFrame(values).coalesce(1)
    table = common.written(rows, "large")
    files = [pq.ParquetFile(f.removeprefix("file://")) for f in table.inputFiles()]
    groups = [f.metadata.row_group(i) for f in files for i in range(f.metadata.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 30 and max(g.total_byte_size for g in groups) < common.GROUP_BYTES + (2 << 20)
    assert sorted((str(r.id), bytes(r.data or b"")) for r in table.collect()) == sorted((str(i), d or b"") for i, d in zip(*(c.to_pylist() for c in values.columns), strict=True))


def test_indexes_of_many_shards_are_read_a_few_at_a_time(spark, monkeypatch):
    """All shards of a task, which come in one file, lay in one row group before."""
    kept = []
    monkeypatch.setattr(decontaminate, "written", lambda df, name: kept.append(common.written(df, name)) or kept[-1])
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(20_000)), lambda i: F.sha2((i + F.col("id") * 100_000).cast("string"), 256)))
    docs = spark.range(0, 20, 1, 1).select(F.col("id").alias("doc_id"), F.concat(text, F.lit(" leaked words here")).alias("text"))
    items = spark.createDataFrame([(1, "Leaked words here")], "item_id long, text string")
    found = decontaminate.find_spans(docs, decontaminate.windows(items)).collect()
    assert sorted((r.doc_id, r.n_words, [tuple(s) for s in r.spans], r["items"]) for r in found) == [(i, 20_004, [(20_001, 20_004)], [1]) for i in range(20)]
    (file,) = kept[0].inputFiles()
    metadata = pq.ParquetFile(file.removeprefix("file://")).metadata
    groups = [metadata.row_group(i) for i in range(metadata.num_row_groups)]
    stored = [sum(g.column(c).total_compressed_size for c in range(metadata.num_columns)) for g in groups]
    assert metadata.num_rows == 20 and max(g.num_rows for g in groups) < 20 and max(stored) < common.GROUP_BYTES + (2 << 20)


def test_scratch_tables_of_texts_take_less_room_than_by_default(spark, tmp_path):
    texts = [" ".join(f"w{i}" for i in np.random.default_rng(k).zipf(1.3, 2000) % 5000) for k in range(400)]
    rows = spark.createDataFrame(pa.table({"text": [*texts, None, ""]})).coalesce(1)
    rows.write.parquet(f"{tmp_path}/plain")
    table = common.written(rows, "texts")
    size = lambda df: sum(Path(f.removeprefix("file://")).stat().st_size for f in df.inputFiles())
    assert size(table) < 0.8 * size(spark.read.parquet(f"{tmp_path}/plain"))
    assert sorted(str(r.text) for r in table.collect()) == sorted([*texts, "None", ""])
