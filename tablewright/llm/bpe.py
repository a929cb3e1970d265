"""Byte-level BPE: encoding by a global table of distinct words, decoding by the token-byte table.

Encoding runs in three steps. (1) Documents are cut into pre-tokens; a block of documents keeps its distinct words only and sends each
to the bucket of its hash, so a frequent word leaves a block once. (2) A bucket holds every occurrence of its words over all blocks,
encodes each distinct word once, and sends the ids back to the blocks. (3) A block joins the ids to its words, puts them in the
place of every position of the word, and cuts the row of ids at the documents' ends.

The blocks of step 3 are found by cutting the documents again rather than by storing or shuffling the texts. ``docs`` must therefore
be a stable scan (a table, not a sample or a limit); a block whose words differ between the two scans ends the job with an error.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import LARGE_BATCH_CHARS, bounded_batches, lean_memory, text_slices, written
from tablewright.llm.pretokens import distinct, pretokens, ragged

WORDS = pa.schema({"bucket": pa.int32(), "block": pa.int64(), "codes": pa.binary(), "words": pa.binary()})
IDS = pa.schema({"block": pa.int64(), "codes": pa.binary(), "counts": pa.binary(), "ids": pa.binary()})
BLOCKS = pa.schema({"block": pa.int64(), "docs": pa.binary(), "words": pa.int64(), "codes": pa.binary()})
ENCODED = pa.schema({"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids": pa.binary(), "decoded": pa.binary()})
SQL_TYPES = {pa.int32(): "int", pa.int64(): "long", pa.float64(): "double", pa.string(): "string", pa.binary(): "binary"}


def sql_schema(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {SQL_TYPES[f.type]}" for f in schema)


def packed(values: np.ndarray) -> bytes:
    """Integers below 2^32, their bytes grouped by significance and compressed."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.compress(planes.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def packed_words(words: pa.Array) -> bytes:
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    data = words.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]] if len(words) else b""
    lengths = packed(np.diff(offsets))
    return len(lengths).to_bytes(4, "little") + lengths + zstandard.compress(data, 1)


def unpacked_words(data: bytes) -> tuple[np.ndarray, bytes]:
    cut = 4 + int.from_bytes(data[:4], "little")
    return unpacked(data[4:cut]), zstandard.decompress(data[cut:])


@cache
def vocabulary(path: str):
    """The tiktoken encoding of a rank file, and its token bytes as one row of bytes with starts and lengths."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    lengths = np.array([len(t) for t in tokens], dtype=np.int64)
    return ranks, encoding, np.frombuffer(b"".join(tokens), dtype=np.uint8), np.cumsum(lengths) - lengths, lengths


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, np.ndarray, pa.Array]]:
    """block id, documents, pre-tokens in each, their word codes, distinct words. Numbered by partition and place in it."""
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part in text_slices(batch, "text", LARGE_BATCH_CHARS):
            words, counts = pretokens(part.column("text"))
            codes, known = distinct(words)
            yield block, part, counts, codes, known
            block += 1


def _word_order(codes: np.ndarray, known: pa.Array) -> np.ndarray:
    """New codes by falling frequency: small numbers are then frequent and pack well. Ties by first occurrence."""
    order = np.argsort(-np.bincount(codes, minlength=len(known)), kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return rank


def _words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, _, codes, known in _blocks(batches):
            rank = _word_order(codes, known)
            bucket = np.fromiter(map(crc32, known.to_pylist()), np.int64, len(known)) % buckets
            order = np.lexsort((rank, bucket))
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            words = known.take(pa.array(order))
            rows = []
            for b in np.flatnonzero(np.diff(ends)).tolist():
                lo, hi = ends[b], ends[b + 1]
                rows.append((b, block, packed(np.diff(rank[order[lo:hi]], prepend=0)), packed_words(words.slice(lo, hi - lo))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), WORDS.types, strict=True)], schema=WORDS)

    return run


def _encode_words(path: str):
    def run(group: pa.Table) -> pa.Table:
        lean_memory()
        ranks, encoding, *_ = vocabulary(path)
        parts = [unpacked_words(x) for x in group.column("words").to_pylist()]
        lengths = np.concatenate([p[0] for p in parts]).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        data = b"".join(p[1] for p in parts)
        words = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        codes, known = distinct(words)
        ids = [(ranks[w],) if w in ranks else encoding._encode_single_piece(w) for w in known.to_pylist()]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int64, int(counts.sum()))
        starts = np.cumsum(counts) - counts
        out, first = [], 0
        for block, own, part in zip(group.column("block").to_pylist(), group.column("codes").to_pylist(), parts, strict=True):
            mine = codes[first : first + len(part[0])]
            first += len(part[0])
            out.append((block, own, packed(counts[mine]), packed(ragged(flat, starts[mine], counts[mine]))))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), IDS.types, strict=True)], schema=IDS)

    return run


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, part, counts, codes, known in _blocks(batches):
        rank = _word_order(codes, known)
        docs = pa.BufferOutputStream()
        rows = pa.record_batch({"doc_id": part.column("doc_id"), "words": pa.array(counts)})
        with pa.ipc.new_stream(docs, rows.schema) as stream:
            stream.write_batch(rows)
        values = ([block], [docs.getvalue().to_pybytes()], [len(known)], [packed(rank[codes])])
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, BLOCKS.types, strict=True)], schema=BLOCKS)


def _assemble(path: str):
    def run(blocks: pa.Table, parts: pa.Table) -> pa.Table:
        lean_memory()
        if len(blocks) != 1:
            raise ValueError("the documents changed between two scans: a block has words but no documents, or appears twice")
        block = blocks.to_pylist()[0]
        docs = pa.ipc.open_stream(block["docs"]).read_all()
        counts = np.zeros(block["words"], dtype=np.int64)
        starts = np.zeros(block["words"], dtype=np.int64)
        flat, seen, size = [], 0, 0
        for part in parts.to_pylist():
            own = np.cumsum(unpacked(part["codes"]), dtype=np.int64)
            lengths = unpacked(part["counts"]).astype(np.int64)
            counts[own] = lengths
            starts[own] = np.cumsum(lengths) - lengths + size
            flat.append(unpacked(part["ids"]))
            seen, size = seen + len(own), size + len(flat[-1])
        if seen != block["words"]:
            raise ValueError("the documents changed between two scans: a block's words differ")
        ids = np.concatenate(flat) if flat else np.empty(0, dtype=np.uint32)
        codes = unpacked(block["codes"])
        ids = ragged(ids, starts[codes], counts[codes]).astype("<u4")
        word_ends = np.concatenate([[0], np.cumsum(counts[codes])])
        ends = word_ends[np.concatenate([[0], np.cumsum(np.asarray(docs.column("words")))])]
        return decoded_rows(docs.column("doc_id").combine_chunks(), ids, ends, path)

    return run


def decoded_rows(doc_ids: pa.Array, ids: np.ndarray, ends: np.ndarray, path: str) -> pa.Table:
    """One row per document; ``ends`` bound the documents in ``ids``. Decoding looks every id up in the token-byte table."""
    *_, token_bytes, token_starts, token_lengths = vocabulary(path)
    text = ragged(token_bytes, token_starts[ids], token_lengths[ids])
    text_ends = np.concatenate([[0], np.cumsum(token_lengths[ids])])[ends]
    cut = lambda values, at: [values[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
    columns = [doc_ids, pa.array(np.diff(ends), pa.int64()), pa.array(cut(ids, ends), pa.binary()), pa.array(cut(text, text_ends), pa.binary())]
    return pa.table(columns, schema=ENCODED)


def encode_decode(docs: DataFrame, path: str, buckets: int | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded``: ids as little-endian unsigned 32-bit integers, and the bytes they decode to.

    ``path`` names a rank file that driver and executors can read. Null texts count as empty: no ids. Rows with equal or null ids are
    encoded one by one. ``buckets`` is the number of word buckets; by default two for each split of the scan, so that the words of one
    bucket are bounded by a split's size.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bounded_batches(texts)
    buckets = buckets or 2 * max(1, texts.rdd.getNumPartitions())
    words = texts.mapInArrow(_words(buckets), sql_schema(WORDS))
    ids = written(words.groupBy("bucket").applyInArrow(_encode_words(path), sql_schema(IDS)), "bpe-words")
    blocks = texts.mapInArrow(_positions, sql_schema(BLOCKS))
    return blocks.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(_assemble(path), sql_schema(ENCODED))
