"""The FM-index against plain search, and the query's operator against a walk over all words."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablewright.llm import decontaminate as dc
from tablewright.llm.fm_index import FMIndex, suffix_order


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=120), st.lists(st.lists(st.integers(2, 5), min_size=1, max_size=4), min_size=1, max_size=8))
def test_index_finds_all_occurrences(text, patterns):
    row = [*text, 1, 0]
    symbols = np.array(row, dtype=np.int32)
    assert suffix_order(symbols).tolist() == sorted(range(len(row)), key=lambda i: row[i:])
    index = FMIndex.from_bytes(FMIndex.of(symbols, pa.array([b"a", b"b", b"c"], pa.large_binary())).to_bytes())
    words = pa.array(["xxabcd"[s].encode() for p in patterns for s in p], pa.large_binary())
    phrase, low, high = index.search(words, np.array([len(p) for p in patterns]))
    got = {p: sorted(index.locate(np.arange(a, b)).tolist()) for p, a, b in zip(phrase.tolist(), low, high, strict=True)}
    want = {k: [i for i in range(len(row)) if row[i : i + len(p)] == p] for k, p in enumerate(patterns)}
    assert got == {k: at for k, at in want.items() if at}


def words(text):
    return re.findall(dc.WORD_PATTERN, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size):
    out = []
    for doc_id, text in docs:
        row, hit, held = words(text), set(), set()
        for item_id, item in items:
            own = words(item)
            for s in range(max(1, len(own) - size + 1)) if own else []:
                window = own[s : s + size]
                for i in range(len(row)):
                    if row[i : i + len(window)] == window:
                        hit |= set(range(i, i + len(window)))
                        held |= {item_id} - {None}
        out.append((str(doc_id), len(row), sorted(hit), sorted(held)))
    return sorted(out)


def test_edge_rows(spark):
    filler = " ".join(f"w{i}" for i in range(3000))
    docs = [(1, None), (2, ""), (3, "?!"), (4, "A b, C\x00d é-f"), (4, "a B"), (None, "x a b y"), (5, filler + " a b " + filler), (6, "a b"), (6, "a b"), (7, "É b c d")]
    items = [(10, "a b"), (9, "b c d é f"), (8, "a b"), (7, None), (6, "--"), (None, "x"), (5, "é b c d"), (4, "w1 w2 w3 w4 w5 w6")]
    d = spark.createDataFrame([(*x, 0, "s") for x in docs], "doc_id long, text string, shard long, items string")
    b = spark.createDataFrame([(*x, "s") for x in items], "item_id long, text string, phrase string")
    for size, chunk in ((3, 10**6), (4, 120)):
        got = dc.find_spans(d, dc.windows(b, size), chunk).collect()
        flat = [(str(r.doc_id), r.n_words, [i for s in r.spans for i in range(s.start, s.end)], r["items"]) for r in got]
        assert sorted(flat) == brute(docs, items, size)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert dc.find_spans(docs.where("false"), dc.windows(items)).count() == 0
    assert [tuple(r)[1:] for r in dc.find_spans(docs, dc.windows(items.where("false"))).collect()] == [(1, 2, [], [])]


def test_rows_keep_their_numbers_when_files_are_packed_anew(spark, tmp_path, monkeypatch):
    """Both stages that apply row numbers to another scan, with other file splits from then on."""
    from tablewright.llm import common, jaccard

    texts = {i: f"text {'copied' if i % 3 == 0 else i} with leaked words here and own words w{i if i % 3 else 0}" for i in range(24)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(24, "doc_id").write.option("maxRecordsPerFile", 1).parquet(f"{tmp_path}/docs")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)

    def packed_anew(docs, rows):
        spark.conf.set(key, "1000")
        return common.split_rows(docs, rows)

    items = spark.createDataFrame([(1, "text copied with leaked")], "item_id long, text string")
    phrases = dc.windows(items)
    for module in (dc, jaccard):
        monkeypatch.setattr(module, "split_rows", packed_anew)
    try:
        cut = dc.cut_spans(spark.read.parquet(f"{tmp_path}/docs"), phrases).collect()
        spark.conf.set(key, before)
        kept = jaccard.keep_one(spark.read.parquet(f"{tmp_path}/docs")).collect()
    finally:
        spark.conf.set(key, before)
    assert {r.doc_id: r.text for r in cut} == {i: t if i % 3 else " words here and own words w0" for i, t in texts.items()}
    assert sorted(r.doc_id for r in kept) == [i for i in range(24) if i == 0 or i % 3]


def test_other_texts_than_those_searched_are_an_error():
    with pytest.raises(ValueError, match="row numbers"):
        dc._without("a b c", [{"start": 0, "end": 1}], 4)
