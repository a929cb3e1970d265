"""Token ids as binary files: patched frame-of-reference blocks, in ascending document order.

A file holds the ids of a range of documents. Its ids are cut into blocks of 128; a block subtracts its minimum, packs the rest at the
width that a chosen percentile of its values needs, and stores larger values whole in an exception list. An index gives the start of every
block, so a reader finds any document without unpacking what comes before it.

File, all numbers little-endian::

    8 bytes   "PFORIDS1"
    4 x u64   documents, ids, blocks, exceptions
    u8  x documents      1 where the document has an id
    i64 x documents      document ids (0 where there is none), ascending, missing ones first
    u64 x documents      end of each document, in ids of this file
    u32 x blocks         minimum of each block
    u8  x blocks         width of each block in bits
    u64 x (blocks + 1)   start of each block in the packed bytes
    u32 x (blocks + 1)   start of each block in the exception list
    u8  x exceptions     place in the block
    u32 x exceptions     value above the minimum
    packed bytes
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.llm.bpe import packed, sql_schema, unpacked
from tablewright.llm.common import LARGE_BATCH_CHARS, bounded_batches, lean_memory, shared_folder, text_slices, written
from tablewright.llm.pretokens import distinct, pretokens, ragged

MAGIC = b"PFORIDS1"
BLOCK = 128
# Share of a block's values that the packed width must hold.
PERCENTILE = 90

TOKENS = pa.schema({"file": pa.int32(), "doc_id": pa.int64(), "n_tokens": pa.int64(), "ids": pa.binary()})
MANIFEST = pa.schema({"file": pa.int32(), "documents": pa.int64(), "n_tokens": pa.int64()})
ROWS = pa.schema({"file": pa.int32(), "doc_id": pa.int64(), "place": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids": pa.binary()})


def pack_blocks(ids: np.ndarray, percentile: int = PERCENTILE) -> tuple[np.ndarray, ...]:
    """minimum, width, byte starts, exception starts, exception places, exception values, packed bytes of all blocks."""
    blocks = -(-len(ids) // BLOCK)
    values = np.empty((blocks, BLOCK), dtype=np.uint32)
    flat = values.reshape(-1)
    flat[: len(ids)] = ids
    flat[len(ids) :] = ids[-1] if len(ids) else 0  # padding that changes no minimum and no width
    least = values.min(axis=1) if blocks else np.empty(0, dtype=np.uint32)
    values -= least[:, None]
    rank = (BLOCK * percentile + 99) // 100 - 1
    chosen = np.partition(values, rank, axis=1)[:, rank] if blocks else np.empty(0, dtype=np.uint32)
    width = np.ceil(np.log2(chosen.astype(np.float64) + 1)).astype(np.uint8)
    over = values.astype(np.uint64) >> width[:, None] != 0
    at = np.argwhere(over)
    exceptions = values[over]
    values[over] = 0
    sizes = width.astype(np.int64) * (BLOCK // 8)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(int(starts[-1]), dtype=np.uint8)
    for bits in np.unique(width).tolist():
        rows = np.flatnonzero(width == bits)
        for part in np.array_split(rows, max(1, len(rows) // 4096)) if bits else []:
            planes = (values[part, :, None] >> np.arange(bits, dtype=np.uint32)) & 1
            done = np.packbits(planes.astype(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
            out[(starts[part][:, None] + np.arange(done.shape[1])).ravel()] = done.ravel()
    exception_starts = np.concatenate([[0], np.cumsum(over.sum(axis=1))])
    return least, width, starts, exception_starts, at[:, 1].astype(np.uint8), exceptions, out


def unpack_blocks(least, width, starts, exception_starts, places, exceptions, data: np.ndarray) -> np.ndarray:
    """The ids of the given blocks, padding included; ``starts`` and ``exception_starts`` have one entry more than blocks."""
    values = np.zeros((len(least), BLOCK), dtype=np.uint32)
    for bits in np.unique(width).tolist():
        rows = np.flatnonzero(width == bits)
        for part in np.array_split(rows, max(1, len(rows) // 4096)) if bits else []:
            raw = data[starts[part].astype(np.int64)[:, None] + np.arange(bits * BLOCK // 8)]
            planes = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(part), BLOCK, bits)
            total = np.zeros((len(part), BLOCK), dtype=np.uint32)
            for b in range(bits):
                total |= planes[:, :, b].astype(np.uint32) << np.uint32(b)
            values[part] = total
    counts = np.diff(exception_starts.astype(np.int64))
    values[np.repeat(np.arange(len(least)), counts), places] = exceptions
    return (values + least[:, None]).reshape(-1)


def file_bytes(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray) -> bytes:
    least, width, starts, exception_starts, places, exceptions, data = pack_blocks(ids)
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], dtype="<i8")
    head = np.array([len(doc_ids), len(ids), len(least), len(exceptions)], dtype="<u8")
    parts = [head, known, numbers, ends.astype("<u8"), least.astype("<u4"), width, starts.astype("<u8"), exception_starts.astype("<u4"), places, exceptions.astype("<u4"), data]
    return MAGIC + b"".join(p.tobytes() for p in parts)


def read_file(content: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc ids, their ends, and all ids of a file."""
    if content[:8] != MAGIC:
        raise ValueError("not a token file")
    at = 8

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        values = np.frombuffer(content, dtype=kind, count=n, offset=at)
        at += values.nbytes
        return values

    docs, size, blocks, exceptions = take("<u8", 4).tolist()
    known, numbers, ends = take("u1", docs), take("<i8", docs), take("<u8", docs)
    least, width, starts = take("<u4", blocks), take("u1", blocks), take("<u8", blocks + 1)
    exception_starts, places, values = take("<u4", blocks + 1), take("u1", exceptions), take("<u4", exceptions)
    ids = unpack_blocks(least, width, starts, exception_starts, places, values, take("u1", int(starts[-1])))[:size]
    return [d if k else None for d, k in zip(numbers.tolist(), known.tolist(), strict=True)], ends.astype(np.int64), ids


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.encode_special_tokens = True  # their strings in a text are ordinary text
    return loaded


class WordCache:
    """The ids of the words met so far in a task, up to a bound; the library encodes every other distinct word once."""

    def __init__(self, path: str, words: int = 500_000) -> None:
        self.path, self.most = path, words
        self.known = pa.array([], pa.large_binary())
        self.lengths = np.empty(0, dtype=np.int64)
        self.flat = np.empty(0, dtype=np.uint32)

    def ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the distinct ``words`` in a row, and how many each has."""
        at = np.array(pc.index_in(words, value_set=self.known).fill_null(-1), dtype=np.int64)
        new = words.filter(pa.array(at < 0))
        ids = [e.ids for e in tokenizer(self.path).encode_batch_fast(new.cast(pa.large_string()).to_pylist(), add_special_tokens=False)]
        fresh = np.fromiter(map(len, ids), np.int64, len(ids))
        if len(self.known) + len(new) > self.most:  # starts anew from these words
            kept = at >= 0
            own = at[kept]
            flat = ragged(self.flat, (np.cumsum(self.lengths) - self.lengths)[own], self.lengths[own])
            self.known, self.lengths, self.flat = words.filter(pa.array(kept)), self.lengths[own], flat
            at[kept] = np.arange(len(own))
        at[at < 0] = len(self.known) + np.arange(len(new))
        self.known = pa.concat_arrays([self.known, new])
        self.lengths = np.concatenate([self.lengths, fresh])
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), np.uint32, int(fresh.sum()))])
        return ragged(self.flat, (np.cumsum(self.lengths) - self.lengths)[at], self.lengths[at]), self.lengths[at]


def encode_texts(texts: pa.Array, cache: WordCache, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in a row, and the end of each text."""
    words, counts = pretokens(texts)
    codes, known = distinct(words)
    flat, lengths = cache.ids_of(known)
    row = ragged(flat, (np.cumsum(lengths) - lengths)[codes], lengths[codes])
    ends = np.concatenate([[0], np.cumsum(lengths[codes])])[np.cumsum(counts)]
    if end_id is None:
        return row, ends
    return np.insert(row, ends, end_id), ends + np.arange(1, len(ends) + 1)


def _encode(path: str, end_id: int | None, bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache(path)
        for batch in batches:
            for part in text_slices(batch, "text", LARGE_BATCH_CHARS):
                ids, ends = encode_texts(part.column("text"), cache, end_id)
                docs = part.column("doc_id")
                files = np.searchsorted(bounds, docs.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False))
                starts = np.concatenate([[0], ends[:-1]])
                cut = [packed(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
                columns = [pa.array(files, pa.int32()), docs, pa.array(ends - starts, pa.int64()), pa.array(cut, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=TOKENS)

    return run


def _write(folder: str):
    def run(group: pa.Table) -> pa.Table:
        lean_memory()
        group = group.sort_by([("doc_id", "ascending"), ("n_tokens", "ascending"), ("ids", "ascending")])
        missing = group.column("doc_id").null_count  # sorted to the end; they come first in the file
        group = pa.concat_tables([group.slice(len(group) - missing), group.slice(0, len(group) - missing)])
        file = group.column("file")[0].as_py()
        ids = np.concatenate([unpacked(x) for x in group.column("ids").to_pylist()])
        ends = np.cumsum(group.column("n_tokens").to_numpy())
        store, path = fs.FileSystem.from_uri(f"{folder}/ids-{file:08d}.pfor")
        trial = f"{path.rpartition('/')[0]}/_{uuid.uuid4().hex}"  # a repeated task replaces its file whole
        with store.open_output_stream(trial) as out:
            out.write(file_bytes(group.column("doc_id").to_pylist(), ends, ids))
        store.move(trial, path)
        return pa.table([[file], [len(group)], [int(ends[-1])]], schema=MANIFEST)

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lean_memory()
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            file = int(path.rpartition("-")[2].removesuffix(".pfor"))
            doc_ids, ends, ids = read_file(content)
            starts = np.concatenate([[0], ends[:-1]])
            for lo in range(0, len(doc_ids), 1000):
                at = slice(lo, lo + 1000)
                cut = [ids[a:b].tobytes() for a, b in zip(starts[at], ends[at], strict=True)]
                place = np.arange(lo, lo + len(cut))
                values = ([file] * len(cut), doc_ids[at], place, starts[at], ends[at] - starts[at], cut)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, ROWS.types, strict=True)], schema=ROWS)


def write_files(docs: DataFrame, path: str, folder: str, end_id: int | None = None, files: int | None = None) -> DataFrame:
    """Write the ids of all documents; returns the manifest ``file, documents, n_tokens`` (one row for each file).

    ``path`` names a tokenizer file and ``folder`` (a path or URI that pyarrow can open on every executor) takes the files. Documents are in
    ascending doc_id order over all files, missing ids first; rows with equal ids stay in one file, ordered by length and content. Null
    texts count as empty. By default there are two files for each split of the scan. An empty table writes no file.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bounded_batches(rows)
    files = files or 2 * max(1, rows.rdd.getNumPartitions())
    # The largest id of every range but the last: as many numbers as files.
    ranges = rows.select("doc_id").where("doc_id IS NOT NULL").repartitionByRange(files, "doc_id")
    ends = ranges.groupBy(F.spark_partition_id().alias("range")).agg(F.max("doc_id").alias("end")).collect()
    bounds = np.array(sorted(r["end"] for r in ends)[:-1], dtype=np.int64)
    store, place = fs.FileSystem.from_uri(folder)
    store.create_dir(place, recursive=True)
    tokens = rows.mapInArrow(_encode(path, end_id, bounds), sql_schema(TOKENS))
    return written(tokens.groupBy("file").applyInArrow(_write(folder), sql_schema(MANIFEST)), "token-manifest")


def read_files(manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document, read from the files: ``start`` counts all ids before it, ``ids`` are
    little-endian unsigned 32-bit integers."""
    spark = manifest.sparkSession
    # One row for each file goes through the window and the broadcast.
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    offsets = manifest.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("offset"))
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(folder).select("path", "content")
    rows = content.mapInArrow(_read, sql_schema(ROWS)).join(F.broadcast(offsets), "file")
    return rows.select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids")


def folder_for(docs: DataFrame) -> str:
    """A new folder beside the other scratch tables."""
    return f"{shared_folder(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
