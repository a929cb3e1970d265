"""Toxicity: the lattice pass against all paths, restored spellings, held-out ranking, edge rows."""

import itertools
import math
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tablewright.llm import toxicity as tx
from tablewright.llm.queries import op7_toxicity, toxicity_model

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    return toxicity_model(spark, SF)


def best_by_hand(core, letters):
    choices, skips = tx._lattice(core, letters.letters)
    options = [[*own, ("", skip)] for own, skip in zip(choices, skips, strict=True)]

    def cost(path):
        row = [0, *(letters.letters.get(c, 1) for c, _ in path if c), 0]
        return sum(letters.after[a, b] for a, b in itertools.pairwise(row)) + sum(p for _, p in path)

    return max(cost(p) for p in itertools.product(*options)), cost


@pytest.mark.parametrize("core", ["1d10t", "l0$er", "aaab", "m.o-r", "x1*y", "$$$", "é0é"])
def test_decode_is_the_best_path(model, core):
    best, _ = best_by_hand(core, model.letters)
    word = tx.restore([core, "qq", core * 3], model.letters)[0]
    choices, skips = tx._lattice(core, model.letters.letters)
    options = [[*own, ("", skip)] for own, skip in zip(choices, skips, strict=True)]
    _, cost = best_by_hand(core, model.letters)
    costs = [cost(p) for p in itertools.product(*options) if "".join(c for c, _ in p) == word]
    assert max(costs) == pytest.approx(best)


def test_obfuscated_words_are_restored(model):
    written = {"1d10t": "idiot", "stuuuupid": "stupid", "p@th3tic": "pathetic", "l0$er": "loser", "m.o.r.o.n": "moron", "sc-um": "scum", "dísgust1ng": None}
    got = tx.restore(list(written), model.letters)
    assert [g for g, w in zip(got, written.values(), strict=True) if w] == [w for w in written.values() if w]
    plain = "the and of that with thing "
    texts = [plain * 5, plain + "1d10t and p@th3tic m0r0n", plain + "you i d i o t s t u p i d l o s e r, 5tup1d"]
    scores, hits = tx.score_texts(pa.array(texts), model)
    assert scores[0] < 0.5 < min(scores[1:])
    assert {"idiot", "pathetic", "moron"} <= {h["word"] for h in hits[1]} and not hits[0]


def test_held_out_ranking(spark):
    truth = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    rows = op7_toxicity(spark, SF).join(truth, "doc_id").where("held_out AND toxic IS NOT NULL").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    # Some labels of this table are noise: no listed word is in the text.
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.97


def test_edge_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "?? !! 123"), (None, "the idiot moron scum"), (5, "the"), (5, "the"), (6, "rrrr" * 5000 + " a" * 50_000)]
    docs = spark.createDataFrame([(*r, 0.5, 1) for r in rows], "doc_id long, text string, score double, toxic int")
    got = {str(r.doc_id): r.score for r in tx.toxicity_of(docs, model).collect()}
    assert got["1"] == got["2"] < 0.5 and got["3"] < 0.5 and got["None"] > 0.5 and all(math.isfinite(s) for s in got.values())
    assert tx.toxicity_of(docs, model).count() == len(rows) and tx.toxicity_of(docs.where("false"), model).count() == 0
    empty = tx.learn(docs, docs.where("false"))
    assert {r.score for r in tx.toxicity_of(docs, empty).collect()} == {0.5}


def test_logistic_separates():
    x = np.array([[0.0], [1.0], [2.0], [3.0]])
    w = tx.logistic(x, np.array([0.0, 0.0, 1.0, 1.0]), ridge=0.01)
    assert w[0] > 0 and w[0] * 1 + w[1] < 0 < w[0] * 2 + w[1]


def test_doubled_spaced_and_cut_words(model):
    """Held-out spellings that only double letters, or set pieces of words apart."""
    plain = "the and of that with thing "
    texts = [plain + t for t in ("stuupid iidiioott", "id iot and mo ron", "s t u p i d", "stu pi d or i diot")]
    scores, hits = tx.score_texts(pa.array([*texts, plain + "the thing is good and all will see a b"], pa.string()), model)
    assert min(scores[:4]) > 0.5 > scores[4]
    found = [{h["word"] for h in own} for own in hits]
    assert {"stupid", "idiot"} <= found[0] and {"idiot", "moron"} <= found[1] and "stupid" in found[2] and {"stupid", "idiot"} <= found[3] and not found[4]


def test_spaced_words_of_any_learned_length():
    words = ("bad", "unmentionables")
    keys = np.sort(np.array([tx.features_of(w)[0] for w in words]))
    odds = tx.Odds(keys, np.full(2, 5.0))
    letters = tx.LetterModel({c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz", 2)}, np.zeros((28, 28)))
    tokens = tx.tokens_of(pa.array(["b a d", "u n m e n t i o n a b l e s", "b b", "bb aadd"]), letters, odds)
    _, scored = tx.doc_features(tokens, odds, letters)
    at = dict(zip(tokens.tokens, scored.tolist(), strict=True))
    assert at["b a d"] == at[" ".join("unmentionables")] == 5.0 and at["b b"] == 0.0


def test_readings():
    assert set(tx.readings("aasshole")) == {"aasshole", "asshole", "aashole", "ashole"} and tx.readings("plain") == ["plain"]


def test_letters_of_other_scripts(model):
    plain = "the and of that with thing "
    texts = [plain + "іdiot and mоrоn", plain + "stupіd", plain + "мир και"]
    scores, hits = tx.score_texts(pa.array(texts), model)
    assert min(scores[:2]) > 0.5 > scores[2]
    assert {"idiot", "moron"} <= {h["word"] for h in hits[0]} and [h["word"] for h in hits[1]] == ["stupid"]


def test_long_tokens_are_read_in_parts(model):
    core = "1d10t.l0$er" * 120
    start = time.process_time()
    assert tx.restore([core], model.letters)[0] == "".join("".join(x) for x in tx._decode([core], model.letters))
    scores, _ = tx.score_texts(pa.array(["x1y2.z3" * 15_000, " ".join("abcdefgh" * 2000)]), model)
    assert all(map(math.isfinite, scores)) and time.process_time() - start < 30


def test_letter_pairs_are_counted_over_all_words():
    texts = ["the the b4d café, ми aaa", None, "", "The x", "?? 12"]
    got = {}
    for part in tx._letter_counts(iter([pa.record_batch({"text": pa.array(texts, pa.string())})])):
        for row in part.to_pylist():
            got[row["a"], row["b"]] = got.get((row["a"], row["b"]), 0) + row["n"]
    want = Counter()
    for word in ["the", "the", "café", "ми", "the", "x"]:
        row = [0, *(ord(c) if ord(c) < tx.LETTERS else 1 for c in word), 0]
        want.update(itertools.pairwise(row))
    assert got == dict(want)
    empty = list(tx._letter_counts(iter([pa.record_batch({"text": pa.array(["12", None], pa.string())})])))
    assert sum(b.num_rows for b in empty) == 0


def test_pieces_are_those_of_joined_texts():
    rng = np.random.default_rng(7)
    words = ["ab", "abc", "cab", "béa", "abcab", "abbéa", "cababc"]
    keys = np.sort(np.array([tx.features_of(w)[0] for w in words]))
    odds = tx.Odds(keys, np.full(len(keys), 5.0))
    cores = ["a", "b", "c", "ab", "abc", "béa", "cab", "", "zzzzzzzzzz", "x"]
    text = np.sort(rng.integers(0, 40, 3000))
    codes = rng.integers(0, len(cores), 3000)
    got = sorted((t, tuple(p)) for t, p in tx._pieces(text, codes, cores, odds))
    want = []
    for s in range(len(codes)):
        for m in range(2, 7):
            own = [cores[c] for c in codes[s : s + m]]
            if len(own) == m and text[s] == text[s + m - 1] and all(own) and "".join(own) in words and set(own) - set(words) and any(len(x) > 1 for x in own):
                want.append((int(text[s]), tuple(own)))
    assert got == sorted(want) and want


def test_simple_words_are_read_as_bytes(monkeypatch):
    rng = np.random.default_rng(3)
    simple = ["".join(rng.choice(list("abcdexyz"), rng.integers(1, 12)).tolist()) for _ in range(3000)]
    odd = ["", "..", "@", "a@", "(b4d)", "aaab", "baaa", "xaab", "béa", "İs", "мир", "b" * 40, "ab" * 16, "ab" * 17, "1", "$$$", "-aa-", "...ab,", "a.b", "ﬁx.", "aa.a", "a_", "ab" * 3000]
    tokens = list(dict.fromkeys([*odd, *simple, *(f"({w})," for w in simple[:500])]))
    words = [tx.core_of(t) for t in tokens]
    keys = np.unique([f for w in words[::3] for f in tx.features_of(w)])
    odds = tx.Odds(keys, rng.normal(0, 3, len(keys)))
    spelled = tx.Spellings.of(pa.array([t.encode() for t in tokens], pa.large_binary()))
    assert spelled.cores == words and spelled.plain.tolist() == [tx.is_plain(w) for w in words] and spelled.sizes.tolist() == [len(w) for w in words]
    rows, features = spelled.features()
    assert len(rows) > 1000
    for row, own in zip(rows.tolist(), features.tolist(), strict=True):
        assert [f for f in own if f >= 0] == tx.features_of(words[row]) and tx.readings(words[row]) == [words[row]]
    letters = tx.LetterModel({c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz", 2)}, np.zeros((28, 28)))
    got = tx.tokens_of(pa.array([" ".join(t for t in tokens if t)]), letters)
    _, scored = tx.doc_features(got, odds, letters)
    assert scored.tolist() == [tx.word_odds(t, w, odds, letters)[0] for t, w in zip(got.tokens, got.words, strict=True)]

    def refused(*_):
        raise AssertionError("a simple word was read one by one")

    for name in ("core_of", "is_plain", "features_of", "readings"):
        monkeypatch.setattr(tx, name, refused)
    simple = [w for w in simple if len(w) > 1 and not tx.TWO_ALIKE.search(w)]
    weak = tx.Odds(keys, np.ones(len(keys)))
    tx.doc_features(tx.tokens_of(pa.array([" ".join(simple)]), letters, weak), weak, letters)


def test_crcs_of_joined_bytes():
    rng = np.random.default_rng(5)
    pairs = [(rng.bytes(int(rng.integers(0, 9))), rng.bytes(int(n))) for n in [0, 1, 63, 64, 65, 128, 200, *rng.integers(0, 70, 50)]]
    first, second = (np.array([tx.crc32(x) for x in side], dtype=np.uint32) for side in zip(*pairs, strict=True))
    got = tx._crc_joined(first, second, np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [tx.crc32(a + b) for a, b in pairs]
