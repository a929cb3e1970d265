"""The pipeline's stages against plain versions, and edge rows through all of them."""

import re

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline as cp  # noqa: E402
from tablewright.llm import bpe, decontaminate, jaccard  # noqa: E402
from tablewright.llm.queries import language_model, op2_language, op7_toxicity, rank_file, toxicity_model  # noqa: E402

SF = "/root/testdata/sf0.001"


def shingles(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def groups(rows, size=3, percent=90):
    """Index of the first row of each row's group; rows without words are alone."""
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(rows))], sets


def words(text):
    return re.findall(decontaminate.WORD_PATTERN, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_run_matches_a_plain_version(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    toxic = {r.doc_id for r in op7_toxicity(spark, SF).where("predicted = 1").collect()}
    odd = {r.doc_id for r in op2_language(spark, SF).where("lang_pred = 'und' OR score < 0.5").collect()}
    rows = sorted((i, t) for i, t in docs.items() if i not in toxic | odd)
    first, _ = groups(rows, cp.COPY_WORDS, cp.COPY_PERCENT)
    rows = [r for k, r in enumerate(rows) if first[k] == k]
    phrases = {r.phrase for r in decontaminate.windows(spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    sizes = {len(p.split(" ")) for p in phrases}
    hit = {i for i, t in rows for w in [words(t)] for n in sizes for k in range(len(w) - n + 1) if " ".join(w[k : k + n]) in phrases}
    got = {r.doc_id: r for r in cp.run(spark, SF).collect()}
    assert set(got) - hit == {i for i, _ in rows} - hit and len(got) < len(docs)
    encoding = bpe.vocabulary(rank_file())[1]
    for i, t in rows:
        if i not in hit:
            assert got[i].n_tokens == len(encoding.encode_ordinary(t or ""))
        elif i in got:
            assert got[i].n_tokens < len(encoding.encode_ordinary(t or ""))


def test_cut_spans(spark):
    rows = [(1, "Keep this. A b, C! and that", 9), (2, "a B c", 5), (2, "none here", 9), (None, None, None), (4, "", 0), (5, "x a b c a b c y", 15), (5, "x a b c a b c y", 15)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, n_chars int, spans string")
    items = spark.createDataFrame([(1, "A b c")], "item_id long, text string")
    plain = docs.drop("spans")
    got = sorted((str(r.doc_id), str(r.text), r.n_chars) for r in decontaminate.cut_spans(plain, decontaminate.windows(items)).collect())
    assert got == sorted([("1", "Keep this. ! and that", 21), ("2", "none here", 9), ("None", "None", None), ("4", "", 0), ("5", "x  y", 4), ("5", "x  y", 4)])


def test_keep_one(spark):
    base = [f"w{i}" for i in range(200)]
    near = [" ".join(base[:k] + ["changed"] + base[k + 1 :]) for k in range(0, 200, 20)]
    rows = [(50 + i, t) for i, t in enumerate(near)] + [(7, " ".join(base)), (7, " ".join(base)), (None, " ".join(base)), (60, None), (61, ""), (62, "  \n"), (8, "a b"), (9, "A  B"), (None, "q")]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, key string, n int")
    got = jaccard.keep_one(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.key) for r in got) == [(False, i, "s") for i in (7, 8, 60, 61, 62)] + [(True, 0, "s")]
    found = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.similar_documents(docs).collect()}
    assert {c for (_, n), c in found.items() if n > 100} == {7} and found[60, 0] == 60 and found[9, 1] == 8 and found[None, 1] is None


def test_stages_take_edge_rows(spark, tmp_path):
    texts = [None, "", "...", "the thing that is", "the thing that is", "idiot moron scum trash", "и это слово", "of the and that with thing is was"]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(None, "for the and that is on thing", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    models = toxicity_model(spark, "/root/testdata/sf0.01"), language_model(spark, SF)
    assert all(m is not None for m in models)
    for table in (docs, docs.where("false")):
        now = table
        for step, (name, stage) in enumerate(cp.STAGES):
            path = f"{tmp_path}/{table is docs}-{step}"
            stage(spark, now, "/root/testdata/sf0.01").write.parquet(path)
            now = spark.read.parquet(path)
            if name != "tokens":
                assert now.columns == docs.columns
        ids = sorted((r.doc_id is None, r.doc_id) for r in now.collect())
        assert ids == ([(False, 3), (False, 7), (True, None)] if table is docs else []) or (table is docs and (False, 6) in ids)
