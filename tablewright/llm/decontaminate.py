"""Benchmark decontamination: an FM-index for each shard of documents, searched for the windows of all benchmark items.

Documents are cut into shards of bounded size; a shard's index is one row of a table in the shared folder and knows nothing of the
benchmark, so it can be searched again. Windows are searched in chunks of a bounded number of bytes: each chunk is broadcast, and
passes over the stored indexes once. The spans found by all chunks are merged for each document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.bpe import packed, sql_schema, unpacked
from tablewright.llm.common import ROW, bounded_batches, lean_memory, numbered, split_rows, text_slices, with_row, written
from tablewright.llm.fm_index import FMIndex
from tablewright.llm.pretokens import distinct, flat_texts

WINDOW = 10
# Windows broadcast at once, in bytes.
CHUNK_BYTES = 16_000_000
# Occurrences located at once.
LOCATE = 500_000

# Words of a text as Spark and Python see them: what is left between ASCII characters other than digits and letters.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TO_LOWER = str.maketrans(UPPER, LOWER)

INDEXES = pa.schema({"shard": pa.int64(), "docs": pa.binary(), "index": pa.binary()})
HITS = pa.schema({"shard": pa.int64(), "starts": pa.binary(), "lengths": pa.binary(), "phrases": pa.binary(), "items": pa.binary()})
SPAN = pa.struct({"start": pa.int32(), "end": pa.int32()})
FOUND = pa.schema({ROW: pa.int64(), "doc_id": pa.int64(), "n_words": pa.int64(), "spans": pa.list_(SPAN), "items": pa.list_(pa.int64())})
FOUND_SQL = f"{ROW} long, doc_id long, n_words long, spans array<struct<start: int, end: int>>, items array<long>"


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, lower-cased in ASCII, and the number in each text."""
    bounds, data = flat_texts(texts)
    raw = np.frombuffer(data, dtype=np.uint8)
    upper = (raw >= 65) & (raw <= 90)
    raw = raw + (upper * np.uint8(32))
    word = (raw >= 128) | ((raw >= 48) & (raw <= 57)) | ((raw >= 97) & (raw <= 122))
    start = word.copy()
    start[1:] &= ~word[:-1]
    firsts = bounds[:-1][np.diff(bounds) > 0]
    start[firsts] = word[firsts]
    kept = np.concatenate([[0], np.cumsum(word)])
    at = np.flatnonzero(start)
    offsets = np.append(kept[at], kept[-1]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(raw[word].tobytes())])
    return words, np.diff(np.append(np.searchsorted(at, bounds[:-1]), len(at)))


def _indexes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part in text_slices(batch, "text"):
            words, counts = words_of(part.column("text"))
            codes, known = distinct(words)
            doc_ends = np.cumsum(counts)
            symbols = np.insert(codes + 2, doc_ends, 1)
            index = FMIndex.of(np.append(symbols, 0).astype(np.int32), known)
            docs = pa.BufferOutputStream()
            rows = pa.record_batch({ROW: part.column(ROW), "doc_id": part.column("doc_id"), "n_words": pa.array(counts, pa.int64())})
            with pa.ipc.new_stream(docs, rows.schema) as stream:
                stream.write_batch(rows)
            values = ([shard], [docs.getvalue().to_pybytes()], [index.to_bytes()])
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, INDEXES.types, strict=True)], schema=INDEXES)
            shard += 1


def words_column(text: str) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD_PATTERN), F.lit(0))


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``phrase, items``: every distinct window of the items' texts (words joined by blanks) and the ids of the items that hold it.

    An item of fewer words, but not none, is one window. Null texts have none; the window of an item without an id marks words but is
    nobody's.
    """
    words = items.select(F.col("item_id").cast("long").alias("item_id"), words_column("text").alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    phrases = F.transform(starts, lambda s: F.array_join(F.slice("w", s, F.lit(size)), " "))
    return words.select("item_id", F.explode(phrases).alias("phrase")).groupBy("phrase").agg(F.collect_set("item_id").alias("items"))


def _search(chunk):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        phrases, items = chunk.value
        words, lengths = words_of(pa.array(phrases, pa.string()))
        item_counts = np.array([len(i) for i in items], dtype=np.int64)
        item_flat = np.array([i for x in items for i in x], dtype=np.int64)
        item_starts = np.cumsum(item_counts) - item_counts
        for batch in batches:
            for shard, data in zip(batch.column("shard").to_pylist(), batch.column("index"), strict=True):
                index = FMIndex.from_bytes(data.as_py())
                phrase, low, high = index.search(words, lengths)
                for lo in range(0, int((high - low).sum()), LOCATE):
                    # Occurrences lo to lo + LOCATE of all that the ranges hold.
                    ends = np.cumsum(high - low)
                    n = np.arange(lo, min(lo + LOCATE, int(ends[-1])))
                    which = np.searchsorted(ends, n, side="right")
                    rows = low[which] + n - (ends - (high - low))[which]
                    at = index.locate(rows)
                    order = np.argsort(at, kind="stable")
                    own = phrase[which][order]
                    of = np.unique(own)
                    local = np.searchsorted(of, own)
                    held = [item_flat[item_starts[p] : item_starts[p] + item_counts[p]] for p in of.tolist()]
                    sink = pa.BufferOutputStream()
                    table = pa.record_batch({"items": pa.array(held, pa.list_(pa.int64()))})
                    with pa.ipc.new_stream(sink, table.schema) as stream:
                        stream.write_batch(table)
                    values = ([shard], [packed(np.diff(at[order], prepend=0))], [packed(lengths[own])], [packed(local)], [sink.getvalue().to_pybytes()])
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, HITS.types, strict=True)], schema=HITS)

    return run


def _merge(shards: pa.Table, hits: pa.Table) -> pa.Table:
    """Spans of hit words and item ids of every document of a shard."""
    lean_memory()
    docs = pa.ipc.open_stream(shards.column("docs")[0].as_py()).read_all()
    counts = docs.column("n_words").to_numpy()
    starts = np.cumsum(counts + 1) - (counts + 1)  # a document's end takes a place too
    size = int((counts + 1).sum())
    change = np.zeros(size + 1, dtype=np.int64)
    pairs = []
    for hit in hits.to_pylist():
        at = np.cumsum(unpacked(hit["starts"]), dtype=np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + unpacked(hit["lengths"]), -1)
        doc = np.searchsorted(starts, at, side="right") - 1
        held = pa.ipc.open_stream(hit["items"]).read_all().column("items").to_pylist()
        seen = np.unique(np.stack([doc, unpacked(hit["phrases"]).astype(np.int64)]), axis=1)
        pairs += [(d, i) for d, p in seen.T.tolist() for i in held[p]]
    hit = np.cumsum(change)[:size] > 0
    edges = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    doc = np.searchsorted(starts, first, side="right") - 1
    spans: list[list] = [[] for _ in range(len(counts))]
    for d, a, b in zip(doc.tolist(), (first - starts[doc]).tolist(), (last - starts[doc]).tolist(), strict=True):
        spans[d].append({"start": a, "end": b})
    items: list[set] = [set() for _ in range(len(counts))]
    for d, i in pairs:
        items[d].add(i)
    columns = [docs.column(ROW).combine_chunks(), docs.column("doc_id").combine_chunks(), pa.array(counts), pa.array(spans, FOUND.types[3]), pa.array([sorted(i) for i in items], FOUND.types[4])]
    return pa.table(columns, schema=FOUND)


def find_spans(docs: DataFrame, phrases: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``_row, doc_id, n_words, spans, items`` of every document: spans are merged ranges of word numbers (from 0, end excluded) that lie in an
    occurrence of some phrase, items the ids of all phrases that occur, ascending.

    ``phrases`` are rows ``phrase, items`` as :func:`windows` makes them; a phrase occurs inside one document only. Rows of ``docs`` with
    equal or null ids are searched one by one, and ``_row`` tells them apart; a null or empty text has no words. ``docs`` must be a stable scan.
    """
    return _find_spans(with_row(docs), phrases, chunk_bytes)


def _find_spans(docs: DataFrame, phrases: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """:func:`find_spans` of rows that have numbers."""
    texts = docs.select(ROW, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    indexes = written(bounded_batches(texts).mapInArrow(_indexes, sql_schema(INDEXES)), "fm-indexes")
    phrases = written(phrases, "phrases")
    size = phrases.agg(F.sum(F.octet_length("phrase") + 8 * F.size("items") + 50)).first()[0] or 0
    chunks = -(-size // chunk_bytes)
    hits = docs.sparkSession.createDataFrame(HITS.empty_table())  # from Arrow: a list would start Python workers of another kind
    for chunk in range(chunks):
        part = phrases.where(F.pmod(F.xxhash64("phrase"), F.lit(chunks)) == chunk).collect()
        shared = docs.sparkSession.sparkContext.broadcast(([r["phrase"] for r in part], [r["items"] for r in part]))
        hits = hits.unionAll(bounded_batches(indexes).select("shard", "index").mapInArrow(_search(shared), sql_schema(HITS)))
    return indexes.select("shard", "docs").groupBy("shard").cogroup(hits.groupBy("shard")).applyInArrow(_merge, FOUND_SQL)


def _without(text: str | None, spans: list[dict], n_words: int) -> str | None:
    """The text, which has so many words, without those of the spans and what stands between them; null if no word is left."""
    words = [m.span() for m in re.finditer(WORD_PATTERN, (text or "").translate(TO_LOWER))]
    if len(words) != n_words:
        raise ValueError(f"spans of a text of {n_words} words met one of {len(words)}: row numbers have changed between scans")
    if sum(s["end"] - s["start"] for s in spans) == len(words):
        return None
    out, at = [], 0
    for span in spans:
        out.append(text[at : words[span["start"]][0]])
        at = words[span["end"] - 1][1]
    return "".join([*out, text[at:]])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [_without(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "n_words")), strict=True)]
        at = batch.schema.get_field_index("text")
        out = batch.set_column(at, "text", pa.array(texts, batch.schema.field(at).type)).drop_columns(["spans", "n_words"])
        yield out.filter(pc.is_valid(out.column(at)))


def cut_spans(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """``docs`` with all their columns, without the words that lie in phrases; a document of nothing else goes.

    Clean rows pass as they are. An ``n_chars`` column follows the text it counts.
    """
    rows = numbered(docs)
    hit = written(_find_spans(rows, phrases).where(F.size("spans") > 0).select(ROW, "spans", "n_words"), "spans")
    doubtful, clean = split_rows(rows, hit)
    # Written, these few rows are chosen once, and no task needs one Python worker to choose and another to cut.
    doubtful = written(doubtful, "doubtful")
    joined = doubtful.join(hit, ROW, "left")
    passed = joined.where("spans IS NULL").select(*docs.columns)
    dirty = joined.where("spans IS NOT NULL").select(*docs.columns, "spans", "n_words")
    cut = bounded_batches(dirty).mapInArrow(_cut, docs.schema)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns).unionAll(passed).unionAll(cut)
