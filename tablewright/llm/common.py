"""What the operators of this subpackage share: reading, scratch tables in the shared folder, batches of bounded size."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.skew import ensure_checkpoint_dir as shared_folder

# Texts handed to one step inside a task, in bytes; a single longer text is a step of its own.
BATCH_CHARS = 2_000_000
# For operators whose traffic falls with larger steps.
LARGE_BATCH_CHARS = 4_000_000
# A row group of a scratch table, in bytes. Spark holds the row groups and pages that a task writes or reads whole, on and off the heap.
GROUP_BYTES = 8 << 20
# Names of settings in the C library.
MALLOC_TRIM_THRESHOLD, MALLOC_MMAP_THRESHOLD = -1, -3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, and safe from lost executors.

    Parquet looks at sizes only after 100 rows by default, so rows of several MB would all be one page of one row group. Zstandard makes
    texts and indexes, which stay there to the end of the session, a third smaller than Spark's default.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    groups = {"parquet.block.size": GROUP_BYTES, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
    df.write.options(**groups).parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(df: DataFrame, rows: int = 2000) -> DataFrame:
    """The same rows; the session sends texts to Python in Arrow batches of this many rows, and about 8 MB, at most.

    Spark's own 10,000 rows are sized for numbers. The settings stay on the session, since Spark reads them when the job runs.
    """
    conf = df.sparkSession.conf
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(key)) > rows:
        conf.set(key, str(rows))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return df


def bucket_of_id(name: str, buckets: int) -> Column:
    """crc32 of the id as text, modulo the number of buckets; how rows are held out."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % buckets


@cache
def lean_memory() -> None:
    """Have this Python worker give freed arrays back at once.

    Workers live on from task to task, and by default both allocators keep what was freed for later. Large arrays get pages of their own
    instead, and Arrow takes from the same allocator. Where the C library has no such setting nothing changes.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(AttributeError, OSError):
        libc = ctypes.CDLL(None)
        for option in (MALLOC_MMAP_THRESHOLD, MALLOC_TRIM_THRESHOLD):
            libc.mallopt(option, 1 << 20)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """A record batch in slices whose texts hold about ``limit`` bytes, without copying."""
    lean_memory()
    texts = batch.column(batch.schema.get_field_index(column))
    sizes = pc.binary_length(texts).fill_null(0).to_pylist()
    start, held = 0, 0
    for row, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def filtered(docs: DataFrame, keep: Callable[[pa.RecordBatch], pa.Array], column: str = "text") -> DataFrame:
    """The rows, with all their columns, for which ``keep`` (a boolean for each row of a batch of bounded texts) is true; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, column):
                yield part.filter(keep(part))

    return bounded_batches(docs).mapInArrow(run, docs.schema)


# A value is hot if more than this part of the rows have it, so that at most as many are.
HOT_KEYS = 1024


def join_hot(rows: DataFrame, of_key: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``of_key``, which has one row for each value of ``key``; null where there is none.

    The rows of hot values, at most HOT_KEYS values, stay where they are and meet a broadcast; only the others are dealt by their value, and
    those without a value not at all. ``rows`` should be a table.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).count()
    hot = counts.where(F.col("count") > rows.count() / HOT_KEYS).select(key)
    few = F.broadcast(written(of_key.join(hot, key), "hot"))
    others = rows.where(F.col(key).isNotNull()).join(few.select(key), key, "left_anti").join(of_key, key, "left")
    return rows.join(few, key).unionByName(others).unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)


# A row's number holds within one scan. Spark may pack files anew in the next, so what applies numbers to another scan takes :func:`numbered`.
ROW = "_row"
MARK_BITS = 26
MARK_PARTS = 256


def with_row(docs: DataFrame) -> DataFrame:
    return docs.withColumn(ROW, F.monotonically_increasing_id())


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` written with their row numbers: the same in every scan, however its files are packed into partitions."""
    return written(with_row(docs), "numbered")


def mark_of(hash64: Column) -> Column:
    return F.shiftrightunsigned(hash64, 64 - MARK_BITS)


def marks(places: DataFrame) -> np.ndarray:
    """A row of 2^26 bits, 8 MB at any number of rows, from a column ``at`` of :func:`mark_of` places."""
    width = 2**MARK_BITS // MARK_PARTS

    def part(group: pa.Table) -> pa.Table:
        bits = np.zeros(width, dtype=np.uint8)
        bits[group.column("at").to_numpy() % width] = 1
        return pa.table({"part": pa.array([group.column("part")[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    parts = places.select("at", F.floor(F.col("at") / width).cast("int").alias("part")).distinct()
    out = np.zeros((MARK_PARTS, width // 8), dtype=np.uint8)
    for row in parts.groupBy("part").applyInArrow(part, "part int, bits binary").collect():
        out[row["part"]] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out.reshape(-1)


def is_marked(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def split_rows(docs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs``, which are :func:`numbered`, as those that may be among ``rows`` (a column ``_row``) and those that are not.

    The first part has all of ``rows`` and few others, so that a join with it moves little text; the second is done. Both are a scan each.
    """
    found = rows.sparkSession.sparkContext.broadcast(marks(rows.select(mark_of(F.xxhash64(ROW)).alias("at"))))
    placed = docs.withColumn("_at", mark_of(F.xxhash64(ROW)))

    def chosen(wanted: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column(batch.schema.get_field_index("_at")).to_numpy()
                yield batch.filter(pa.array(is_marked(found.value, at) == wanted))

        return bounded_batches(placed).mapInArrow(run, placed.schema).drop("_at")

    return chosen(True), chosen(False)
