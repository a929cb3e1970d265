"""Token files: the block codec, the file format, and the query against the library."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("public_tokenizers")

from tablewright.llm import token_files as tf  # noqa: E402
from tablewright.llm.queries import op9_token_files, tokenizer_file  # noqa: E402


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700), st.sampled_from([1, 50, 90, 100]))
def test_blocks_round_trip(values, percentile):
    ids = np.array(values, dtype=np.uint32)
    assert tf.unpack_blocks(*tf.pack_blocks(ids, percentile))[: len(ids)].tolist() == values


def test_outliers_are_exceptions():
    ids = np.array([7] * 120 + [4_000_000_000] * 8, dtype=np.uint32)
    least, width, _, _, places, values, data = tf.pack_blocks(ids)
    assert (least.tolist(), width.tolist(), len(data)) == ([7], [0], 0)
    assert places.tolist() == list(range(120, 128)) and set(values.tolist()) == {4_000_000_000 - 7}


def brute(rows, end_id):
    encoder = tf.tokenizer(tokenizer_file())
    start, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = encoder.encode(text or "", add_special_tokens=False).ids + ([] if end_id is None else [end_id])
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_edge_rows(spark, tmp_path):
    rows = [(5, None), (3, ""), (9, "it's\n\n  <|endoftext|> é"), (-4, "x " * 50_000), (7, "same"), (6, "same"), (None, "no id")]
    rows += [(100 + i, "b" * i) for i in range(300)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, file int")
    for end_id, files in ((2, 4), (None, 1)):
        folder = f"{tmp_path}/{files}"
        manifest = tf.write_files(docs, tokenizer_file(), folder, end_id, files)
        got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in tf.read_files(manifest, folder).collect()]
        # Documents without ids share their start with the next one.
        assert sorted(got, key=lambda r: (r[1], r[2], str(r[0]))) == sorted(brute(rows, end_id), key=lambda r: (r[1], r[2], str(r[0])))


@pytest.mark.parametrize("most", [0, 3, 1000])
def test_word_cache_starts_anew(most):
    cache, plain = tf.WordCache(tokenizer_file(), most), tf.tokenizer(tokenizer_file())
    for texts in (["a bcd xyzzy", ""], ["bcd q", None], ["a q\n\nxyzzy", "é"]):
        ids, ends = tf.encode_texts(pa.array(texts, pa.string()), cache, None)
        want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == [i for x in want for i in x] and ends.tolist() == np.cumsum([len(x) for x in want]).tolist()


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    manifest = tf.write_files(docs, tokenizer_file(), f"{tmp_path}/none")
    assert tf.read_files(manifest, f"{tmp_path}/none").count() == 0


def test_query_matches_the_library(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, op9_token_files(spark, sf_dir).collect())) == sorted(brute([tuple(d) for d in docs], 2))
