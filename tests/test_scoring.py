import pytest
from pyspark.sql import functions as F

from tablewright.functions import normalize
from tablewright.operators import scoring


@pytest.mark.parametrize(
    "pred, ref, same",
    [
        ("1, 2", "2, 1.0", True),
        ("nan", "nan", False),
        ("1d", "1", False),
        ("-0.0", "0", True),
        ("a, a", "a", False),
        (" Old Town ", "old town", True),
        ("1,2", "1, 2", False),
        ("", "", True),
        ("inf", "Infinity", True),
        ("a\n", "\t\u00a0A", True),
        (None, "", True),
        (None, "a", False),
    ],
)
def test_denotation(spark, pred, ref, same):
    df = spark.createDataFrame([(pred, ref)], "pred string, ref string")
    assert scoring.denotation_match(df).first()["is_correct"] is same


@pytest.mark.parametrize(
    "target, pred, strict, flexible",
    [
        (["1", "1"], ["1"], True, True),  # values are sets
        (["2001-xx-xx"], ["2001"], True, True),  # a lone year is a number
        (["2001-05-xx"], ["2001-5-xx"], True, True),
        (["2001-05-07"], ["2001-05-08"], False, False),
        (["5 weeks"], ["5"], False, True),
        (["$5"], ["5.0"], False, True),
        (["no"], ["False"], False, True),
        (["1"], ["yes"], False, True),
        (["no"], ["yes"], False, False),
        (["a", "b"], ["b", "a"], True, True),
        (["Café (bar)"], ["cafe"], True, True),
        (["1.0000001"], ["1"], True, True),
        (["xx-xx-xx"], ["yy"], False, False),
        (["9007199254740993"], ["9007199254740992"], False, True),  # flexible compares as doubles
        (["9007199254740993"], [" 9_007_199_254_740_993"], True, True),
        (["9007199254740992"], ["9007199254740992.0"], True, True),
    ],
)
def test_value_matches(spark, target, pred, strict, flexible):
    df = spark.createDataFrame([(target, pred)], "target array<string>, pred array<string>")
    assert scoring.strict_match(df).first()["strict"] is strict
    assert scoring.flexible_match(df).first()["flexible"] is flexible


@pytest.mark.parametrize(
    "written, normal",
    [
        ("Émile  Zola.", "emile zola"),
        ("“Quoted”", "quoted"),
        ("Name (born 1950) (x)[2]*", "name"),
        ("[1]", ""),
        ("a–b`s", "a-b's"),
        ("(x)", "(x)"),
        (None, None),
    ],
)
def test_normalize(written, normal):
    assert normalize.normalized(written) == normal


def test_similarity():
    assert normalize.similarity("kitten", "sitting") == 62
    assert normalize.similarity("", "") == 100 and normalize.similarity("", "a") == 0 and normalize.similarity(None, "a") == 0

    def common(a, b):
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
        return rows[-1][-1]

    for a, b in [("select a from w", "select b from w where"), ("abcabba", "cbabac"), ("xyz", "abc"), ("naïve", "naive" * 40)]:
        assert normalize.common_length(a, b) == common(a, b)


def test_functions_work_in_sql(spark):
    normalize.register(spark)
    row = spark.sql("SELECT normalize_text('Á.') AS n, fuzz_ratio('ab', 'abc') AS r").first()
    assert tuple(row) == ("a", 80)


def test_summary(spark):
    rows = [("1", "a", "a"), ("1", "b", "a"), ("1", "ab", "a"), ("2", "x", "x")]
    df = spark.createDataFrame(rows, "checkpoint string, pred string, ref string")
    got = {r["checkpoint"]: r for r in scoring.summarize(df, ["checkpoint"]).collect()}
    assert got["1"]["samples"] == 3 and got["1"]["denotation_accuracy"] == pytest.approx(1 / 3)
    assert got["1"]["distance_mode"] == 1 and got["1"]["distance_std"] == pytest.approx((2 / 9) ** 0.5)
    assert got["2"]["distance_std"] == 0.0


def test_missing_predictions_count_as_empty_text(spark):
    df = spark.createDataFrame([("1", None, "ab"), ("1", "ab", "ab")], "checkpoint string, pred string, ref string")
    got = scoring.summarize(df, ["checkpoint"]).first()
    assert (got["samples"], got["denotation_accuracy"], got["distance_mean"], got["distance_std"]) == (2, 0.5, 1.0, 1.0)


def test_target_values_are_read_from_canonical_texts(spark):
    row = (["Five", "May 2001", "Bob."], ["5.0", "2001-05-xx", "bob"])
    df = spark.createDataFrame([row], "values array<string>, canonical array<string>")
    got = [(v["key"]["kind"], v["key"]["num"], v["norm"]) for v in scoring.target_values(df).first()["target"]]
    assert got == [("number", 5.0, "five"), ("date", None, "may 2001"), ("text", None, "bob")]
