import pytest
from pyspark.sql import functions as F

from tablewright.corpus import raw_cells
from tablewright.operators import answers, derived, linear
from tablewright.operators.typing import apply_column_types, type_results, vote_column_types


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("v")).first()["v"]


def test_round_trip_and_unreadable_text(spark):
    texts = [
        (1, " col : a | b c row 1 : 1 | x y row 2 :  | z"),
        (2, " col : a | b"),
        (3, " col : a | b row 1 : 1 | 2 row 2 : 3"),
        (4, "nothing"),
    ]
    tables = spark.createDataFrame(texts, "table_id long, linear_text string")
    rows, headers, bad = linear.delinearize(tables)
    assert [(r["row_pos"], r["cells"]) for r in rows.orderBy("row_pos").collect()] == [(1, ["1", "x y"]), (2, ["", "z"])]
    assert headers.first()["header"] == ["a", "b c"]
    assert {r["table_id"]: r["problem"] for r in bad.collect()} == {2: "no rows", 3: "ragged", 4: "no header"}


def test_missing_cells_print_none(spark):
    rows = spark.createDataFrame([(1, 1, [(None, None), ("x", None)])], "table_id int, row_pos long, cells array<struct<raw:string,num:double>>")
    meta = spark.createDataFrame([(1, ["a", "b"])], "table_id int, header array<string>")
    assert linear.linearize(rows, meta).first()["linear_text"] == " col : a | b row 1 : none | x"


@pytest.mark.parametrize(
    "query, expected",
    [
        ("select year won where year > 3", "select col_1 where col_0 > 3 "),
        ("select yearly where year not null", "select yearly where col_0 is not null "),
        ("a is not null and year not null", "a is not null and col_0 not null "),
    ],
)
def test_rename_headers(spark, query, expected):
    assert one(spark, linear.rename_headers(F.col("q"), F.array(F.lit("year"), F.lit("year won"))), q=query) == expected


def test_split_needs_exactly_one_table(spark):
    df = spark.createDataFrame([("select a col : x row 1 : 1",), ("no table",), ("a col : b col : c",)], "question string")
    assert [r["split_ok"] for r in linear.split_question(df).collect()] == [True, False, False]


def test_column_votes(spark):
    rows = spark.createDataFrame(
        [(1, 1, ["1", "2001-02-03", "x"]), (1, 2, ["n/a", "soon", "y"]), (1, 3, [None, "March 5, 2001", None])],
        "table_id int, row_pos long, cells array<string>",
    )
    votes = vote_column_types(raw_cells(rows))
    assert [r["kind"] for r in votes.orderBy("col_pos").collect()] == ["number", "timestamp", "text"]
    cells = apply_column_types(rows, votes).orderBy("row_pos").collect()
    assert [r["cells"][0]["num"] for r in cells] == [1.0, None, None]
    assert [str(r["cells"][1]["at"])[:10] for r in cells] == ["2001-02-03", "None", "2001-03-05"]


def test_result_kinds(spark):
    texts = ["1| 2", "1| none", "0.5| 1", "t| none", "a,, b| c", "1,, 2", "  ", "007"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, result_text string")
    kinds = [r["kind"] for r in type_results(df).orderBy("i").collect()]
    assert kinds == ["int", "text", "float", "bool", "list", "number_list", "empty", "text"]


def test_answer_texts(spark):
    def numbers(values):
        return one(spark, answers.numbers_text(F.from_json(F.lit(values), "array<double>")))

    assert numbers("[1.0, 2.0]") == "1| 2" and numbers("[1.0, 2.5]") == "1.0| 2.5" and numbers("[1.0, null]") == "1.0| nan"
    collapsed = answers.collapse_answers(F.array(F.lit("a"), F.lit("a")))
    assert one(spark, collapsed) == ["a"]


def test_derived_columns(spark):
    df = spark.createDataFrame([(1, "a,b-c"), (1, None), (2, "a-b-c/d"), (3, "a\nb")], "k int, t string")
    chosen = {r["k"]: r["delimiter"] for r in derived.choose_delimiter(df, ["k"], "t").collect()}
    assert chosen == {1: ",", 2: "-", 3: "\n"}  # equal counts go to the comma
    text = F.col("t")
    assert one(spark, derived.list_items(text, F.lit("-")), t="a - b-/c") == ["a", "b", "c"]
    assert one(spark, derived.latest_years(text), t="in 1990, 1985-1999") == ["1990", "1999"]
    assert one(spark, derived.earliest_years(text), t="none, 1985-1999") == [None, "1985"]
    assert one(spark, derived.range_maximums(text), t="7, 3-12") == ["7", "12"]
    assert one(spark, derived.names_before_brackets(text), t="Ann Lee (1st), Bob") == ["Ann Lee", "Bob"]
    assert one(spark, derived.month_number(text), t="12 May 2001") == "5"
    assert one(spark, derived.month_number(text), t="Sep 2001") is None
    assert one(spark, derived.first_year(text), t="12345 or 1999") == "1999"
    assert one(spark, derived.first_number(text), t="v 10.25 of 3") == 10.25


def test_date_forms_of_web_tables(spark):
    from tablewright.operators.typing import to_timestamp

    written = {
        "2003-10-05": "2003-10-05 00:00:00", "2003-1-5": "2003-01-05 00:00:00", "1/5/2003": "2003-01-05 00:00:00", "01/05/2003": "2003-01-05 00:00:00",
        "Jan 5, 2003": "2003-01-05 00:00:00", "October 5, 2003": "2003-10-05 00:00:00", "5 Oct 2003": "2003-10-05 00:00:00", "5 May 2003": "2003-05-05 00:00:00",
        "October 2003": "2003-10-01 00:00:00", "Oct 2003": "2003-10-01 00:00:00", "2003-10-05 10:11": "2003-10-05 10:11:00", "2003-10-05T10:11:12Z": "2003-10-05 10:11:12",
        "2003-10-05T10:11:12+02:00": "2003-10-05 08:11:12", " 2003/10/05\n": "2003-10-05 00:00:00", "2003-10-05 10:11:12.5": "2003-10-05 10:11:12.5",
        "2003": None, "13/45/2003": None, "Foo 5, 2003": None, "team of 2003 won": None, "": None, None: None,
    }
    df = spark.createDataFrame([(w,) for w in written], "w string")
    got = {r["w"]: r["at"] for r in df.select("w", to_timestamp(F.col("w")).cast("string").alias("at")).collect()}
    assert got == written
