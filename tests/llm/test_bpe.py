"""Encoding and decoding against the library, text by text."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from tablewright.llm import bpe  # noqa: E402
from tablewright.llm.pretokens import pretokens  # noqa: E402
from tablewright.llm.queries import op3_byte_bpe, rank_file  # noqa: E402

PATTERN = regex.compile(public_tokenizers.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("abstdmrvle' \n\t1é!日½\x85\x1c "), max_size=30), max_size=5))
def test_pretokens_match_the_pattern(texts):
    words, counts = pretokens(pa.array(texts, pa.string()))
    assert [w.decode() for w in words.to_pylist()] == [w for t in texts for w in PATTERN.findall(t)]
    assert counts.tolist() == [len(PATTERN.findall(t)) for t in texts]


def expected(text):
    encoding = bpe.vocabulary(rank_file())[1]
    ids = encoding.encode_ordinary(text or "")
    return ids, np.array(ids, dtype="<u4").tobytes(), encoding.decode_bytes(ids)


def test_edge_rows(spark, tmp_path):
    texts = [None, "", " ", "a" * 3000, "it's 'tis\n\n  end  ", "日本語 text 123", "same", "same", "x " * 200_000]
    rows = [(i, t, "z") for i, t in enumerate(texts)] + [(None, "no id", None), (1, "twice", None)]
    spark.createDataFrame(rows, "doc_id long, text string, block string").write.parquet(f"{tmp_path}/d.parquet")
    docs = spark.read.parquet(f"{tmp_path}/d.parquet")
    got = bpe.encode_decode(docs, rank_file(), buckets=3).collect()
    want = sorted((str(i), len(expected(t)[0]), *expected(t)[1:]) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in got) == want
    assert bpe.encode_decode(docs.where("doc_id < 0"), rank_file()).count() == 0


def test_query_matches_the_library(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((d.doc_id, len(expected(d.text)[0]), *map(sha, expected(d.text)[1:])) for d in docs)
    assert sorted(map(tuple, op3_byte_bpe(spark, sf_dir).collect())) == want
