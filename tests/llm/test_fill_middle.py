"""Cut and restored texts against a plain reading of the rule, edge rows, and the query against SQL."""

import hashlib
import re

import pytest

from tablewright.llm import fill_middle as fim
from tablewright.llm.queries import REGISTRY
from tests.oracle import compare, duck

SCHEMA = "doc_id long, text string, n string, form int, output long, id string, h1 string"
TEXTS = [
    None, "", "\n", "one", "one\n", "a\nb\nc\nd", "a\n\n\nb\n", "\r\n\r\n", "has <S> in it\nx", "<P", "<M\n>", "<\n<P\nS>\n<S", "é😀\nß\n😀😀", "$1 \\ $2\n{3}\n",
    "x" * 300_000, "\n" * 50_000, "".join(f"line {i}\n" for i in range(40_000)) + "end",
]


def plain(doc_id, text, rate, spm_rate):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < spm_rate else "psm"
    return len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("rate", "spm_rate"), [(100, 50), (40, 0), (100, 100), (0, 50)])
def test_outputs_match_the_rule_and_give_the_text_back(spark, rate, spm_rate):
    rows = [(None if i == 7 else i % 60, t) for i, t in enumerate(TEXTS * 9 if rate == 100 else TEXTS)]
    df = spark.createDataFrame([(*r, "x", 1, 2, "y", "z") for r in rows], SCHEMA)
    out = fim.fill_in_middle(df, rate=rate, spm_rate=spm_rate)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = [(r.doc_id, *r[1:6], r.back) for r in out.withColumn("back", fim.restored(out.output, out.form)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[-1], r[2])
    assert sorted(got, key=key) == sorted([(i, *plain(i, t, rate, spm_rate), t or "") for i, t in rows], key=key)


def test_other_units(spark):
    df = spark.createDataFrame([(i, "ab cd  ef gh") for i in range(20)], "doc_id long, text string")
    out = fim.fill_in_middle(df, unit=r"\S+\s*+")
    rows = out.withColumn("back", fim.restored(out.output, out.form)).collect()
    assert {r.n for r in rows} == {4} and {r.back for r in rows} == {"ab cd  ef gh"}
    assert {r.prefix_chars for r in rows} <= {0, 3, 7, 10, 12} and len({r.prefix_chars for r in rows}) > 2


def test_rows_stay_where_they_are(spark):
    plan = fim.fill_in_middle(spark.createDataFrame([], SCHEMA))
    assert plan.count() == 0
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Python" not in text


def test_query_matches_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    entry = REGISTRY["op11_fill_in_middle"]
    assert compare(spark, duck(sf_dir), entry.run, entry.sql, sf_dir)[0] == ""
