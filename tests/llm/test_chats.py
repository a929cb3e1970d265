"""Snapshots of conversations against a plain comparison of turn lists; rendering; edge rows."""

import pytest

from tablewright.llm import chats
from tablewright.llm.queries import REGISTRY
from tests.oracle import compare, duck

SCHEMA = "conv_id long, turn long, role string, text string, pos int, h1 string"
A, B, C = ("user", "hi"), ("assistant", "yes <|end|> ?"), ("user", "more")


def conv(conv_id, *turns, step=1):
    return [(conv_id, i * step, *t) for i, t in enumerate(turns)]


ROWS = [
    *conv(1, A), *conv(2, A, B), *conv(3, A, B, C), *conv(4, A, B, C), *conv(5, A, C), *conv(6, B), *conv(7, A, B, C, A), *conv(8, A, ("assistant", "hi")),
    *conv(9, A, B, C, A, step=300), *conv(10, ("assistant", "hi"), A), *conv(10, ("assistant", "hi"), A), (11, None, None, None), (11, 5, "user", None), (12, 0, "unknown", ""),
    (None, 0, "user", "lost"), (13, 1, "user", "same turn"), (13, 1, "assistant", "same turn"), *conv(14, *[("user", f"t{i}") for i in range(700)]), *conv(15, *[("user", f"t{i}") for i in range(650)]),
]


def brute(rows):
    own = {}
    for c, turn, role, text in sorted(set(rows), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "unknown", r[3] or "")):
        if c is not None:
            own.setdefault(c, []).append((role or "unknown", text or ""))
    safe = lambda s: s.replace("<|", "<\\|")
    out = []
    for c, turns in own.items():
        same = [d for d, other in own.items() if other == turns]
        longer = any(len(other) > len(turns) and other[: len(turns)] == turns for other in own.values())
        if not longer and c == min(same):
            out.append((c, len(turns), len(same), "".join(f"<|{safe(r)}|>\n{safe(t)}<|end|>\n" for r, t in turns)))
    return sorted(out)


@pytest.mark.parametrize("segment", [1000, 3])
def test_maximal_conversations(spark, segment):
    df = spark.createDataFrame([(*r, 1, "x") for r in ROWS], SCHEMA)
    got = {}
    for r in sorted(chats.format_chats(df, segment).collect(), key=lambda r: (r.conv_id, r.segment)):
        key = (r.conv_id, r.n_turns, r.n_copies)
        assert r.text.count("<|end|>\n") <= segment
        got[key] = got.get(key, "") + r.text
    assert sorted((*k, t) for k, t in got.items()) == brute(ROWS)


def test_empty_table(spark):
    assert chats.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_matches_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    entry = REGISTRY["op8_chat_format"]
    assert compare(spark, duck(sf_dir), entry.run, entry.sql, sf_dir)[0] == ""
