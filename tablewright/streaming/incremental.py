"""Arriving files converted once each, and scores kept up to date as predictions arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tablewright.operators.scoring import denotation_match, edit_distance, given

_HISTOGRAM = [StructField("n_correct", LongType()), StructField("distances", ArrayType(LongType())), StructField("counts", ArrayType(LongType()))]


def arriving_files(
    spark: SparkSession, folder: str, schema: StructType, glob: str, files_per_batch: int = 1000, kind: str = "parquet"
) -> DataFrame:
    """A stream over the files of a folder that match a name pattern."""
    reader = spark.readStream.format(kind).schema(schema).option("pathGlobFilter", glob)
    return reader.option("maxFilesPerTrigger", files_per_batch).load(folder)


def _write_batches(stream: DataFrame, out_dir: str, checkpoint: str, mode: str) -> StreamingQuery:
    def write(batch: DataFrame, batch_id: int) -> None:
        # A repeated batch writes to the same place, so it never counts twice.
        batch.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def convert_arriving(
    stream: DataFrame, convert: Callable[[DataFrame], DataFrame], out_dir: str, checkpoint: str
) -> StreamingQuery:
    """Convert what has arrived since the last run, then stop. Interrupted runs go on where they were."""
    return _write_batches(convert(stream), out_dir, checkpoint, "append")


class DistanceHistogram(StatefulProcessor):
    """Per key: how often each edit distance came up, and how many predictions were right.

    The state is a map with one entry for each distance, so an arriving row changes one entry and a key never holds its rows.
    """

    def __init__(self, keys: StructType) -> None:
        self._keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._counts = handle.getMapState("counts", "distance long", "n long")
        self._correct = handle.getValueState("correct", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        correct = self._correct.get()[0] if self._correct.exists() else 0
        for part in rows:
            correct += int(part["n"][part["is_correct"]].sum())
            for distance, n in part.groupby("distance")["n"].sum().items():
                known = self._counts.getValue((int(distance),))
                self._counts.updateValue((int(distance),), ((known[0] if known else 0) + int(n),))
        self._correct.update((correct,))
        histogram = sorted((d[0], n[0]) for d, n in self._counts.iterator())
        named = {field.name: [value] for field, value in zip(self._keys, key, strict=True)}
        yield pd.DataFrame({**named, "n_correct": [correct], "distances": [[d for d, _ in histogram]], "counts": [[n for _, n in histogram]]})

    def close(self) -> None:
        pass


def running_scores(predictions: DataFrame, keys: list[str], out_dir: str, checkpoint: str) -> StreamingQuery:
    """Keep a histogram of edit distances per key of arriving ``(keys, pred, ref)``. A missing answer counts as empty text.

    The session has to use the RocksDB state store, which :func:`stateful` sets for the time of a run.
    """
    scored = denotation_match(predictions).withColumn("distance", edit_distance(given("pred"), given("ref")).cast("long"))
    rows = scored.select(*keys, "is_correct", "distance")
    key_schema = StructType([rows.schema[k] for k in keys])
    whole = [*keys, "is_correct", "distance"]

    def combined(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.groupby(whole, dropna=False).size().reset_index(name="n")

    # Counted before the shuffle: a key sends as many rows as it has distances, whatever its share of all rows.
    rows = rows.mapInPandas(combined, StructType([*rows.schema, StructField("n", LongType())]))
    schema = StructType([*key_schema, *_HISTOGRAM])
    totals = rows.groupBy(*keys).transformWithStateInPandas(DistanceHistogram(key_schema), schema, "Update", "None")
    with stateful(predictions.sparkSession):
        return _write_batches(totals, out_dir, checkpoint, "update")


@contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state needs, while a stream is being started; the session's own is set again."""
    name, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, store)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def latest_scores(spark: SparkSession, out_dir: str, keys: list[str]) -> DataFrame:
    """The newest scores of every key that ``running_scores`` has written: the figures of ``summarize`` over all that has arrived."""
    newest = spark.read.parquet(out_dir).groupBy(*keys).agg(F.max_by(F.struct("n_correct", "distances", "counts"), "batch_id").alias("t"))
    pairs = F.arrays_zip(F.col("t.distances").alias("d"), F.col("t.counts").alias("n"))
    wide = lambda c: c.cast("decimal(38,0)")
    total = lambda term: F.aggregate(pairs, F.lit(0).cast("decimal(38,0)"), lambda acc, p: (acc + wide(term(p))).cast("decimal(38,0)"))
    # The most frequent distance; of equally frequent ones the lowest.
    mode = F.array_max(F.transform(pairs, lambda p: F.struct(p["n"].alias("n"), (-p["d"]).alias("d"))))
    counted = newest.select(*keys, "t.n_correct", total(lambda p: p["n"]).alias("n"), total(lambda p: p["d"] * p["n"]).alias("sum"), total(lambda p: p["d"] * p["d"] * p["n"]).alias("squares"), (-mode["d"]).cast("int").alias("mode"))
    n = F.col("n").cast("double")
    return counted.select(
        *keys,
        F.col("n").cast("long").alias("samples"),
        (F.col("n_correct") / n).alias("denotation_accuracy"),
        (F.col("sum").cast("double") / n).alias("distance_mean"),
        (F.sqrt((F.col("n") * F.col("squares") - F.col("sum") * F.col("sum")).cast("double")) / n).alias("distance_std"),
        F.col("mode").alias("distance_mode"),
    )
