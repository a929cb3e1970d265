import math

import pytest
from pyspark.sql import functions as F

from tablewright.functions import numbers, text

NUMBERS = [5.0, 0.0, -0.0, 1e7, 12345678.25, 1e15, 9999999999999998.0, 1e16, 1.5e16, 1e-3, 1e-4, 0.00012345, 1e-5, 1.5e-7]
NUMBERS += [1e100, 1.2e-150, math.nan, math.inf, -math.inf, 123.456, 1 / 3, 2 / 3 * 1e8, 1e22, -1e7, -2.5e-9]
TEXTS = ["1,000.7", "1_000", "1d", "nan", "+inf", "-Infinity", " 5 ", "1e3", "007", ".5", "5.", "", "abc", "1__0", "0x1", "-0", "1e", "_1", "5f"]


def values(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in df.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def python_float(t):
    try:
        return float(t)
    except ValueError:
        return None


def test_float_text_is_python_str(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(NUMBERS)], "i int, x double")
    printed = [r["v"] for r in df.select("i", numbers.float_text(F.col("x")).alias("v")).orderBy("i").collect()]
    assert printed == [str(x) for x in NUMBERS]


def test_to_float_is_python_float(spark):
    assert [str(v) for v in values(spark, TEXTS, numbers.to_float)] == [str(python_float(t)) for t in TEXTS]


@pytest.mark.parametrize(
    "written, number",
    [("1,000.7", 1000.7), ("1,000", 1000.0), ("5,55", 5.55), ("0.0.1", 1.0), ("abc", None), ("0,0,0,1", 1.0), ("123,4", 1234.0)]
    + [("1.2.3,4", None), ("1,,2", 12.0)],
)
def test_loose_float(spark, written, number):
    assert values(spark, [written], numbers.loose_float) == [number]


def test_kinds_and_prints(spark):
    assert values(spark, ["7", "1e3", "x", None], numbers.value_kind) == ["int", "float", "text", "text"]
    assert values(spark, ["+007", "-0", "1e3", "x", "-12"], numbers.value_text) == ["7", "0", "1000.0", "x", "-12"]
    assert values(spark, ["0", "007", "-01", "12", "1.5", None], numbers.is_strict_int) == [True, False, False, True, False, False]
    assert values(spark, ["0.0", "0.5", "00.5", "-0.5", "-01", "x"], numbers.is_strict_float) == [True, True, False, True, False, False]


def test_julian_days_are_true_in_january_too(spark):
    assert values(spark, ["2001-01-01", "2000-02-29", "bad", "2001-02-30"], numbers.julian_day) == [2451910.5, 2451603.5, None, None]


def test_exact_sum_does_not_depend_on_partitions(spark):
    df = spark.range(1000).select(F.round(F.col("id") * 0.1 + 0.01, 2).alias("x"))
    sums = {df.repartition(n).agg(numbers.exact_sum(F.col("x")).alias("s")).first()["s"] for n in (1, 7, 64)}
    assert len(sums) == 1


def test_text_rules(spark):
    assert values(spark, ["'a'", '"a"', "'", "'a\"", "a"], text.strip_quotes) == ["a", "a", "", "'a\"", "a"]
    assert values(spark, ["Émile's 2nd—try_1!?"], text.tokens) == [["émile", "'", "s", "2nd", "—", "try_1", "!?"]]
    assert values(spark, [r"a\nb|c\pd\\e"], text.unescape_list) == [["a\nb", "c|d\\e"]]
    assert values(spark, ["select * from w where c not null"], text.clean_query_text) == ["select id from w where c is not null"]


def test_float_pattern_gives_nothing_back(spark):
    texts = ["1_2_3.4_5e6_7", "1_2_", "1._5", "infinity", "Infinit", "\t1.\n", "1e+", "+.5E-3", "1..2", "12e5x", "__1", ".", "5\n\n", "9" * 400 + "x"]
    assert [str(v) for v in values(spark, texts, numbers.to_float)] == [str(python_float(t)) for t in texts]


def test_a_cell_is_read_as_a_number_once(spark):
    from tablewright.operators.typing import identify_cells

    cells = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "raw string").repartition(2)
    typed = identify_cells(cells)
    assert typed.columns == ["raw", "kind", "num", "value"]
    assert typed._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") == 1
    got = {r["raw"]: str(r["num"]) for r in typed.collect()}
    assert all(got[t] == str(python_float(t)) for t in TEXTS) and got[None] == "None"


def test_only_cells_with_a_mark_of_dates_are_parsed(spark):
    from tablewright.operators.typing import to_timestamp

    texts = ["2001-02-03", " 2001/2/3 ", "3 Mar 2001", "Mar 2001", "2001-02-03T04:05", "20010203", "12345678.25", "1,234,567", "abcdefgh ij"]
    plan = spark.createDataFrame([(t,) for t in texts], "t string").select("t", to_timestamp(F.col("t")).alias("at"))
    assert "contains(t" in plan._jdf.queryExecution().analyzed().toString().lower()
    assert [r["t"] for r in plan.collect() if r["at"] is not None] == texts[:5]
