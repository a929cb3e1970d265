"""Language labels: held-out accuracy, spans of mixed texts, the Viterbi pass against all paths, edge rows."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

from tablewright.llm import language as lg
from tablewright.llm.queries import language_model, op2_language

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return language_model(spark, SF)


def test_held_out_accuracy(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = op2_language(spark, SF).join(truth, "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98


def test_viterbi_is_the_best_path(model):
    words = lg.words_of(pa.array(["The thing und der Schule que la maison the", "uno", "", "le das"]))
    labels = lg._labels(words, model, 3.0)
    start = 0
    for count in words.counts.tolist():
        lengths = words.end - words.start
        scores = []
        for w in range(start, start + count):
            grams = words.trigrams[words.first[w] : words.first[w] + lengths[w]]
            scores.append(np.where(model.candidates[words.script[w]], model.scores[grams].sum(axis=0), lg.IMPOSSIBLE))
        cost = lambda path, s=scores: sum(s[i][p] for i, p in enumerate(path)) - 3.0 * sum(a != b for a, b in itertools.pairwise(path))
        best = max(itertools.product(range(len(model.langs)), repeat=count), key=cost) if count else ()
        assert cost(labels[start : start + count]) == pytest.approx(cost(best), rel=1e-5)
        start += count


def test_mixed_text_has_spans(spark, model):
    docs = {r.lang: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) between 800 and 1500").collect()}
    text = f"{docs['de']} {docs['en']} 123 ?"
    langs, scores, spans = lg.identify(pa.array([text]), model)
    assert 0 < scores[0] < 1 and langs[0] in ("de", "en")
    assert {s["lang"] for s in spans[0]} == {"de", "en"}
    assert all(a["end"] <= b["start"] for a, b in itertools.pairwise(spans[0])) and spans[0][-1]["end"] <= len(text)


def test_edge_rows(spark, model):
    long = "und der die das " * 30_000
    rows = [(1, None), (2, ""), (3, "123 !?"), (None, "the thing"), (5, "the thing"), (5, "the thing"), (6, long), (7, "Это слово")]
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang_pred string, score double")
    got = sorted((str(r.doc_id), r.lang_pred, r.score) for r in lg.language_of(docs, model).collect())
    assert [g for g in got if g[0] in "123"] == [(str(i), "und", 0.0) for i in (1, 2, 3)]
    assert [g[1:] for g in got if g[0] in ("5", "None")] == [("en", 1.0)] * 3 and ("6", "de", 1.0) in got
    assert all(0 <= g[2] <= 1 for g in got)
    nothing = lg.learn(docs.where("false").withColumn("lang", docs["lang_pred"]))
    assert {r.lang_pred for r in lg.language_of(docs, nothing).collect()} == {"und"}
    assert lg.language_of(docs.where("false"), model).count() == 0


def test_more_languages_than_a_byte_tells(spark):
    """With 300 languages of one word each, every text gets its own."""
    words = ["".join(chr(97 + (n // 26**k) % 26) * 3 for k in range(2)) for n in range(300)]
    rows = [(i * 1000 + k, f"{word} " * 5, f"l{i:03}") for i, word in enumerate(words) for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = lg.language_of(docs, lg.learn(docs))
    assert {(r.doc_id // 1000, r.lang_pred) for r in found.collect()} == {(i, f"l{i:03}") for i in range(300)}


def test_a_rare_language_is_learned_whole(spark):
    common = spark.range(20_000).selectExpr("id AS doc_id", "'the thing that is' AS text", "'en' AS lang")
    rare = spark.range(20_000, 20_012).selectExpr("id AS doc_id", "'und der schule' AS text", "'de' AS lang")
    model = lg.learn(common.unionByName(rare), most=200)
    assert model.langs == ["de", "en"]
    assert lg.equal_part([12, 20_000], 200) == 188 and lg.equal_part([5, 6], 100) == 6 and lg.equal_part([], 9) == 0
