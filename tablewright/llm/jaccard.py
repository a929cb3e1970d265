"""N-gram Jaccard join: which documents share a given part of their word n-grams (90 % of 3-grams by default), and the groups that such links form.

Documents with equal sets are one class from the start. Every other link is found by prefix filtering: with the n-grams of all sets in
one order, rare ones first, two sets of n that link share one within their first ``n - ceil(0.9 n) + 1`` (0.9 or what part is asked for). Length and positional filters
drop most of those pairs, a suffix filter (how many hashes each set has in each of 64 ranges) most of the rest, and each pair left is
verified once on the whole sets.

The groups need no link between documents that are connected already, so pairs are formed in rounds: first each shared n-gram's earliest
class against all its others, which a group of near copies of one text collapses under; when the pairs between unconnected classes have
become few, or a round connects nothing more, all of them. No link between different groups is left out, and copies are never expanded.

Texts are cut into n-grams twice, for the counters and for the prefixes; the sets of the classes that share a rare n-gram with others are
written once, for all rounds. What many rows or pairs may share (a class, a group, the class at the centre of a round) is dealt by salted keys
or broadcast, when so few keys can hold so many rows.

N-grams are 64-bit hashes, sets 128-bit digests of them. The order of rarity comes from shared counters of fixed size filled from all documents:
any one order finds all links, a finer count only makes fewer candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.bpe import packed, sql_schema, unpacked
from tablewright.llm.common import ROW, bounded_batches, is_marked, join_hot, lean_memory, mark_of, marks, numbered, split_rows, text_slices, with_row, written
from tablewright.llm.components import components
from tablewright.llm.pretokens import distinct, flat_texts

# Unless others are asked for: links need PERCENT * (size of the union) / 100 shared shingles of SIZE words.
PERCENT = 90
SIZE = 3
COUNTER_BITS = 24
RANGES = 64
COUNTER_PARTS = 64
# All pairs between unconnected classes are formed once there are at most so many for each posting.
PAIRS_PER_POSTING = 0.5
# Pairs of one class that are verified in one group, about.
PAIRS_AT_ONCE = 1024

LEVELS = pa.schema({"part": pa.int32(), "levels": pa.binary()})
# A document's row has no ``part``; the other rows are counters.
SEEN = pa.schema({
    ROW: pa.int64(), "doc_id": pa.int64(), "hash": pa.int64(), "key": pa.binary(), "n": pa.int32(), "ranges": pa.binary(),
    "part": pa.int32(), "at": pa.binary(), "times": pa.binary(),
})
PREFIXES = pa.schema({"bucket": pa.int32(), "grams": pa.binary(), "keys": pa.binary(), "sizes": pa.binary(), "places": pa.binary()})
POSTINGS = pa.schema({"gram": pa.int64(), "key": pa.binary(), "n": pa.int32(), "pos": pa.int32()})
SETS = pa.schema({"key": pa.binary(), "grams": pa.binary()})
PAIR = pa.schema({"a": pa.int64(), "b": pa.int64()})


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts (what white space of ASCII separates) with A-Z lower-cased, and the number in each text."""
    bounds, data = flat_texts(texts)
    raw = np.frombuffer(data, dtype=np.uint8)
    raw = raw + (((raw >= 65) & (raw <= 90)) * np.uint8(32))
    word = (raw != 32) & ((raw < 9) | (raw > 13))
    start = word.copy()
    start[1:] &= ~word[:-1]
    firsts = bounds[:-1][np.diff(bounds) > 0]
    start[firsts] = word[firsts]
    kept = np.concatenate([[0], np.cumsum(word)])
    at = np.flatnonzero(start)
    offsets = np.append(kept[at], kept[-1]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(raw[word].tobytes())])
    return words, np.diff(np.append(np.searchsorted(at, bounds[:-1]), len(at)))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: pa.Array, size: int = SIZE) -> list[np.ndarray]:
    """The distinct shingle hashes of every text, ascending; the whole word sequence is one shingle where it is shorter than ``size``."""
    words, counts = words_of(texts)
    codes, known = distinct(words)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, known.to_pylist()), np.uint64, len(known))[codes]
    hashes = np.concatenate([hashes, np.zeros(size - 1, dtype=np.uint64)])
    n = len(codes)
    total = np.zeros(n, dtype=np.uint64)
    ends = np.cumsum(counts)
    left = np.repeat(ends, counts) - np.arange(n)  # words from here to the text's end
    for i in range(size):
        part = hashes[i : n + i] * np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1) ** 3) & (2**64 - 1))
        total += np.where(left > i, part, np.uint64(0))
    total = _mixed(total + np.minimum(left, size).astype(np.uint64))
    starts = ends - counts
    lengths = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    return [np.unique(total[s : s + k]) for s, k in zip(starts.tolist(), lengths.tolist(), strict=True)]


def set_key(grams: np.ndarray) -> bytes | None:
    return blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None


def _slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for part in text_slices(batch, "text"):
            yield part, shingle_sets(part.column("text"), size)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _rows(schema: pa.Schema, **columns: pa.Array) -> pa.RecordBatch:
    """Columns not given are null."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)


def _seen(bits: int, parts: int, size: int):
    """One row for each document, and how often each counter is met, in parts of the counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 2**bits // parts
        for part, sets in _slices(batches, size):
            ranges = [packed(np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=RANGES).astype("<u4")) for s in sets]
            own = {name: part.column(name) for name in (ROW, "doc_id", "hash")}
            yield _rows(SEEN, **own, key=pa.array(map(set_key, sets), pa.binary()), n=pa.array(map(len, sets), pa.int32()), ranges=pa.array(ranges, pa.binary()))
            grams = np.concatenate([np.empty(0, dtype=np.uint64), *sets])
            at, n = np.unique((grams >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
            ends = np.searchsorted(at, np.arange(parts + 1) * width)
            met = np.flatnonzero(np.diff(ends)).tolist()
            places = [packed(np.diff(at[ends[p] : ends[p + 1]] - p * width, prepend=0)) for p in met]
            times = [packed(n[ends[p] : ends[p + 1]]) for p in met]
            yield _rows(SEEN, part=pa.array(met, pa.int32()), at=pa.array(places, pa.binary()), times=pa.array(times, pa.binary()))

    return run


def _levels(width: int):
    """Counts added up, in eighths of a power of two."""

    def run(group: pa.Table) -> pa.Table:
        lean_memory()
        total = np.zeros(width, dtype=np.float64)
        for row in group.to_pylist():
            total[np.cumsum(unpacked(row["at"]), dtype=np.int64)] += unpacked(row["times"])
        levels = np.minimum(np.log2(total + 1) * 8, 255).astype(np.uint8)
        return pa.table([[group.column("part")[0].as_py()], [levels.tobytes()]], schema=LEVELS)

    return run


def rarity(counted: DataFrame, bits: int = COUNTER_BITS, parts: int = COUNTER_PARTS) -> np.ndarray:
    """One byte for each of ``2^bits`` counters: how frequent the shingles are whose hashes begin with it. 16 MB by default, at any input size."""
    levels = counted.groupBy("part").applyInArrow(_levels(2**bits // parts), sql_schema(LEVELS)).collect()
    out = np.zeros((parts, 2**bits // parts), dtype=np.uint8)
    for row in levels:
        out[row["part"]] = np.frombuffer(row["levels"], dtype=np.uint8)
    return out.reshape(-1)


def needed(a: int, b: int, percent: int = PERCENT) -> int:
    """Shared shingles that sets of these sizes need to link."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def _prefixes(levels, buckets: int, size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(64 - int(len(levels.value)).bit_length() + 1)
        for _, sets in _slices(batches, size):
            by_key = {set_key(s): s for s in sets if len(s)}
            grams, keys, sizes, places = [], [], [], []
            for key, own in by_key.items():
                rare = np.argsort(levels.value[(own >> shift).astype(np.int64)], kind="stable")[: prefix_length(len(own), percent)]
                grams.append(own[rare])
                keys.append(np.full(len(rare), key, dtype="V16"))
                sizes.append(np.full(len(rare), len(own)))
                places.append(np.arange(len(rare)))
            if not grams:
                continue
            grams, keys, sizes, places = map(np.concatenate, (grams, keys, sizes, places))
            bucket = (grams % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for b in np.flatnonzero(np.diff(ends)).tolist():
                own = order[ends[b] : ends[b + 1]]
                rows.append((b, grams[own].tobytes(), keys[own].tobytes(), packed(sizes[own]), packed(places[own])))
            yield _batch(PREFIXES, rows)

    return run


def _shared(percent: int):
    """Postings of the shingles that more than one class has in its prefix, each class once."""

    def run(group: pa.Table) -> pa.Table:
        lean_memory()
        rows = group.to_pylist()
        grams = np.concatenate([np.frombuffer(r["grams"], dtype=np.uint64) for r in rows])
        keys = np.concatenate([np.frombuffer(r["keys"], dtype="V16") for r in rows])
        halves = keys.view("<u8").reshape(-1, 2)
        order = np.lexsort((halves[:, 1], halves[:, 0], grams))
        gram, half = grams[order], halves[order]
        new_gram = np.ones(len(order), dtype=bool)
        new_gram[1:] = gram[1:] != gram[:-1]
        new = new_gram.copy()
        new[1:] |= (half[1:] != half[:-1]).any(axis=1)
        order, new_gram = order[new], new_gram[new]
        starts = np.flatnonzero(new_gram)
        sizes = np.diff(np.append(starts, len(order)))
        order, sizes = order[np.repeat(sizes > 1, sizes)], sizes[sizes > 1]
        n, pos = (np.concatenate([unpacked(r[c]) for r in rows]).astype(np.int64)[order] for c in ("sizes", "places"))
        able = _has_partner(sizes, n, pos, percent)
        order, n, pos = order[able], n[able], pos[able]
        columns = [pa.array(grams[order].view(np.int64)), pa.array([k.tobytes() for k in keys[order]], pa.binary()), pa.array(n, pa.int32()), pa.array(pos, pa.int32())]
        return pa.table(columns, schema=POSTINGS)

    return run


# A shingle of more classes than this keeps all its postings; pairs are tested one by one later in any case.
MOST_TESTED = 4096


def _passes(n: np.ndarray, pos: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of the last axis pass the length and positional filters."""
    total = n[..., :, None] + n[..., None, :]
    shared = -(-percent * total // (100 + percent))
    left = np.minimum((n - pos)[..., :, None], (n - pos)[..., None, :])
    even = np.minimum(n[..., :, None], n[..., None, :]) * 100 >= np.maximum(n[..., :, None], n[..., None, :]) * percent
    return even & (left >= shared)


def _has_partner(sizes: np.ndarray, n: np.ndarray, pos: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Postings that pass the filters with some other posting of their shingle; ``sizes`` are the postings of each, in order."""
    starts = np.cumsum(sizes) - sizes
    able = np.zeros(len(n), dtype=bool)
    for size in np.unique(sizes).tolist():
        firsts = starts[sizes == size]
        if size > MOST_TESTED:
            able[(firsts[:, None] + np.arange(size)).ravel()] = True
            continue
        step = max(1, 2_000_000 // size**2)
        for lo in range(0, len(firsts), step):
            at = firsts[lo : lo + step, None] + np.arange(size)
            passes = _passes(n[at], pos[at], percent)
            passes[:, np.arange(size), np.arange(size)] = False
            able[at] = passes.any(axis=2)
    return able


def _sets(asked, size: int):
    """The sets of the documents whose hash is marked; the others' texts are not cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(batch.schema.get_field_index("at")).to_numpy()
            for _, sets in _slices(iter([batch.filter(pa.array(is_marked(asked.value, at)))]), size):
                yield _batch(SETS, list({set_key(s): s.tobytes() for s in sets if len(s)}.items()))

    return run


def _suffix_filter(percent: int):
    """Pairs whose sets could share enough by their counts in each range of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            ranges = [np.stack([unpacked(r) for r in batch.column(c).to_pylist()]).astype(np.int64) for c in ("ranges_a", "ranges_b")]
            most = np.minimum(*ranges).sum(axis=1)
            total = ranges[0].sum(axis=1) + ranges[1].sum(axis=1)
            able = most * (100 + percent) >= percent * total
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], schema=PAIR).filter(pa.array(able))

    return run


def _verify(percent: int):
    """Pairs of one class with others that link."""

    def run(own: pa.Table, others: pa.Table) -> pa.Table:
        if not len(own) or not len(others):
            return PAIR.empty_table()
        mine = np.frombuffer(own.column("grams")[0].as_py(), dtype=np.uint64)
        rows = []
        for a, b, grams in zip(others.column("of").to_pylist(), others.column("b").to_pylist(), others.column("theirs"), strict=True):
            theirs = np.frombuffer(grams.as_py(), dtype=np.uint64)
            shared = len(np.intersect1d(mine, theirs, assume_unique=True))
            if 100 * shared >= percent * (len(mine) + len(theirs) - shared):
                rows.append((a, b))
        return pa.table([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], schema=PAIR)

    return run


@dataclass
class Classes:
    """``members``: _row, doc_id, key, n. ``labels``: key and label of the classes that share rare shingles with others."""

    members: DataFrame
    labels: DataFrame


def _able(x: DataFrame, y: DataFrame, percent: int, once: Column) -> DataFrame:
    """Distinct pairs ``a`` of x and ``b`` of y, unconnected classes that share a shingle and pass the length and positional filters there."""
    both = x.alias("x").join(y.alias("y"), F.col("x.gram") == F.col("y.gram"))
    size = F.col("x.n") + F.col("y.n")
    shared = F.ceil(size * percent / (100 + percent))
    long_enough = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent
    in_place = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) >= shared
    kept = both.where((F.col("x.label") != F.col("y.label")) & once & long_enough & in_place)
    return kept.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def link_classes(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> Classes:
    """The classes of equal sets of ``docs``, which have row numbers, and which of them links connect."""
    texts = docs.select(ROW, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Known by what they hold, rows are found again however a later scan deals them.
    texts = texts.withColumn("hash", F.xxhash64("doc_id", "text"))
    bounded_batches(texts)
    spark, buckets = docs.sparkSession, 2 * max(1, texts.rdd.getNumPartitions())
    seen = written(texts.mapInArrow(_seen(COUNTER_BITS, COUNTER_PARTS, size), sql_schema(SEEN)), "members")
    members = seen.where("part IS NULL").select(ROW, "doc_id", "hash", "key", "n", "ranges")
    levels = spark.sparkContext.broadcast(rarity(seen.where("part IS NOT NULL").select("part", "at", "times")))
    prefixes = texts.select("text").mapInArrow(_prefixes(levels, buckets, size, percent), sql_schema(PREFIXES))
    postings = written(prefixes.groupBy("bucket").applyInArrow(_shared(percent), sql_schema(POSTINGS)), "postings")
    levels.unpersist()
    own = members.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc"), F.min("hash").alias("hash"), F.first("ranges").alias("ranges"))
    # Numbers take less room than digests in all that follows.
    classes = own.join(postings.select("key").distinct(), "key", "left_semi").withColumn("id", F.monotonically_increasing_id())
    classes = written(classes, "classes")
    labels = classes.select("id", F.col("id").alias("label"))
    live = written(postings.join(classes.select("key", "id", "doc"), "key").drop("key"), "live")
    sets = None if live.isEmpty() else _class_sets(texts, classes, size)
    links, last = None, False
    while sets is not None:
        labelled = written(live.join(labels, "id"), "labelled")
        sizes = labelled.groupBy("gram", "label").count().groupBy("gram").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count")).alias("own"))
        work = sizes.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("own")) / 2)).first()
        if not work[1]:
            break
        last = last or work[1] <= PAIRS_PER_POSTING * work[0]
        if last:
            pairs = _able(labelled, labelled, percent, F.col("x.id") < F.col("y.id"))
        else:
            first = labelled.groupBy("gram").agg(F.min(F.struct("doc", "id", "n", "pos", "label")).alias("p")).select("gram", "p.*")
            pairs = _able(first, labelled, percent, F.lit(True))
            live = written(labelled.join(first.select("gram", "id"), ["gram", "id"], "left_anti").drop("label"), "live")
        found = _linked(sets, classes, pairs, percent)
        if found is not None:
            links = found if links is None else links.unionAll(found)
            roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
            joined = classes.select("id").join(roots.withColumnRenamed("node", "id"), "id", "left")
            labels = written(joined.select("id", F.coalesce("root", "id").alias("label")), "labels")
        if last:
            break
        last = found is None
    return Classes(members, classes.select("key", "id").join(labels, "id").select("key", "label"))


def _class_sets(texts: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """``id, grams`` of the classes, each from one of its documents, whose text is read again."""
    marked = texts.sparkSession.sparkContext.broadcast(marks(classes.select(mark_of(F.col("hash")).alias("at"))))
    read = texts.select("text", mark_of(F.col("hash")).alias("at")).mapInArrow(_sets(marked, size), sql_schema(SETS))
    one = read.groupBy("key").agg(F.first("grams").alias("grams"))
    sets = written(one.join(classes.select("key", "id"), "key").select("id", "grams"), "sets")
    marked.unpersist()
    return sets


def _linked(sets: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame | None:
    """The pairs that link, by the suffix filter and then the whole sets. Many pairs may share ``a``."""
    ranges = lambda side: classes.select(F.col("id").alias(side), F.col("ranges").alias(f"ranges_{side}"))
    carried = join_hot(written(pairs, "candidates"), ranges("a"), "a").join(ranges("b"), "b")
    able = written(carried.select("a", "b", "ranges_a", "ranges_b").mapInArrow(_suffix_filter(percent), sql_schema(PAIR)), "pairs")
    count = able.count()
    if not count:
        return None
    dealt = able.withColumn("deal", F.pmod(F.xxhash64("b"), F.lit(1 + count // PAIRS_AT_ONCE)))
    mine = dealt.select("a", "deal").distinct().join(sets.withColumnRenamed("id", "a"), "a")
    theirs = dealt.join(sets.select(F.col("id").alias("b"), F.col("grams").alias("theirs")), "b")
    theirs = theirs.select(F.col("a").alias("of"), F.col("deal").alias("dealt"), "b", "theirs")
    found = mine.groupBy("a", "deal").cogroup(theirs.groupBy("of", "dealt")).applyInArrow(_verify(percent), sql_schema(PAIR))
    found = written(found, "links")
    return None if found.isEmpty() else found


def similar_documents(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``.

    ``n_shingles`` is the size of its set; ``component_id`` the smallest doc_id that links reach, its own included. Rows without words are
    linked with nothing and keep their own id. Rows that share an id are judged one by one; a missing id is never the smallest unless
    a group has no other. ``docs`` must be a stable scan, since texts are read again rather than stored.
    """
    found = link_classes(with_row(docs), size, percent)
    members = found.members.select("doc_id", "key", "n")
    own = members.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc"))
    groups = own.join(found.labels, "key").groupBy("label").agg(F.min("doc").alias("least"))
    grouped = join_hot(found.labels, groups, "label").select("key", "least")
    least = written(own.join(grouped, "key", "left").select("key", F.coalesce("least", "doc").alias("least")), "least")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return join_hot(members, least, "key").select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row of each group of connected rows, with all its columns: that of the smallest doc_id, or of the first row without any id.

    Rows without words are no copies of each other and stay.
    """
    rows = numbered(docs)
    found = link_classes(rows, size, percent)
    worded = found.members.where("key IS NOT NULL")
    firsts = worded.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)).alias("first"))
    group = F.coalesce(F.concat(F.lit("c"), F.col("label").cast("string")), F.hex("key"))
    kept = firsts.join(found.labels, "key", "left").groupBy(group.alias("group")).agg(F.min("first").alias("first")).select(F.col(f"first.{ROW}").alias(ROW))
    dropped = written(worded.select(ROW).join(kept, ROW, "left_anti"), "dropped")
    doubtful, others = split_rows(rows, dropped)
    return others.select(*docs.columns).unionAll(doubtful.join(dropped, ROW, "left_anti").select(*docs.columns))
