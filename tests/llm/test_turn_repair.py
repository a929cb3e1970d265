"""Repairs against a search over all edits, long conversations in pieces, edge rows, and the query against SQL."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tablewright.llm import turn_repair as tr
from tablewright.llm.queries import REGISTRY, damaged, op12_turn_repair
from tests.oracle import compare, duck

SCHEMA = "conv_id long, turn long, role string, text string, place string, codes int, piece long"
DARK = re.compile(r"[^\x20\x09-\x0D]")


def judged(rows):
    """(initial class, fault) of the turns of one conversation in order."""
    out, seen = [], set()
    for _, role, text in rows:
        dark = DARK.findall(text)
        fault = tr.BLANK if not dark else tr.DUPLICATE if (role, text) in seen else tr.TRUNCATED if dark[-1] not in ".!?" else tr.SOUND
        seen.add((role, text))
        out.append((role[:1], fault))
    return out


def cheapest(rows):
    """Cost, audit and repaired turns by a search that keeps every equally good walk, as text."""
    fits = lambda roles: re.fullmatch(r"s?(ua)*u?", roles) is not None
    now = {"": (0, "", [])}  # by initials that are left: cost, audit, turns
    key = lambda v: (v[0], v[1])

    def put(into, roles, value):
        short = roles if len(roles) < 4 else roles[0] * (roles[0] == "s") + "ua" + roles[-1] * (roles[-1] == "u")
        if fits(roles) and (short not in into or key(value) < key(into[short])):
            into[short] = value

    def inserted(states):
        for _ in range(4):
            new = dict(states)
            for roles, (c, a, t) in states.items():
                for who in ("user", "assistant"):
                    put(new, roles + who[0], (c + 3, a + "I", [*t, f"{who}:"]))
            states = new
        return states

    now = inserted(now)
    for (_, role, text), (initial, fault) in zip(rows, judged(rows), strict=True):
        new = {}
        for roles, (c, a, t) in now.items():
            put(new, roles, (c + 4, a + "D", t))
            if fault in (tr.SOUND, tr.TRUNCATED):
                more = 3 * (fault == tr.TRUNCATED)
                if initial in "sua" and initial:
                    put(new, roles + initial, (c + more, a + "K", [*t, f"{role}:{text}"]))
                for who in ("user", "assistant"):
                    put(new, roles + who[0], (c + more + 3, a + "R", [*t, f"{who}:{text}"]))
        now = inserted(new)
    return min((v for roles, v in now.items() if re.fullmatch(r"(s?(ua)+)?", roles)), key=key)


def brute(rows):
    """The contract's row of every conversation of damaged ``(conv_id, turn, role, text)``."""
    out = {}
    fill = lambda r: (r[0], r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3])
    order = lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode())
    for conv, group in itertools.groupby(sorted(map(fill, rows), key=lambda r: (r[0] is not None, r[0] or 0, order(r))), key=lambda r: r[0]):
        turns = [r[1:] for r in group]
        faults = [f for _, f in judged(turns)]
        known = {t for t, _, _ in turns if t is not None}
        cost, audit, left = cheapest(turns)
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        out[conv] = (gaps, *[faults.count(f) for f in (tr.BLANK, tr.DUPLICATE, tr.TRUNCATED)], illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


def repaired(spark, rows):
    done = tr.repair(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA))
    digest = {r.conv_id: r.repaired_sha256 for r in tr.digests(done.turns).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, digest.get(r.conv_id, nothing)) for r in done.report.collect()}


def random_rows(seed, convs, longest):
    rng = random.Random(seed)
    roles = ["user", "user", "assistant", "assistant", "system", "usher", "tool", "", None]
    texts = ["yes.", "no", "why? ", " \n", "", None, "ä!", "…", "one. two", "ok.\t"]
    rows = []
    for conv in range(convs):
        for _ in range(rng.randrange(1, longest)):
            rows.append((conv, rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.7 else f"t{rng.randrange(99)}."))
    return rows


@pytest.mark.parametrize("bits", [12, 2])
def test_repairs_match_a_search(spark, monkeypatch, bits):
    """In whole conversations and in pieces of four turns."""
    monkeypatch.setattr(tr, "PIECE_BITS", bits)
    rows = random_rows(1, 250, 12) + [(None, 1, "user", "hi."), (None, 1, "user", "hi."), (-5, 2**62, "assistant", "a"), (-5, -(2**62), None, None)]
    assert repaired(spark, rows) == brute(rows)


def test_small_conversations_in_all_forms():
    """The integer walk against the search, for every conversation of up to four turns over five kinds of turn."""
    kinds = [("system", "a."), ("user", "b."), ("assistant", "c"), ("user", ""), ("tool", "d.")]
    for n in range(1, 5):
        for combo in itertools.product(kinds, repeat=n):
            rows = [(i, role, text and f"{i}{text}") for i, (role, text) in enumerate(combo)]
            codes = "".join(tr.LETTERS[4 * f + ("sua".index(k) if k in "sua" else 3)] for k, f in judged(rows))
            cost, audit = tr.least_repair([tr.best_walks(codes)])
            assert (cost, audit.decode()) == cheapest(rows)[:2], combo
            assert tr.least_repair([tr.best_walks(c) for c in codes]) == (cost, audit)


def test_one_conversation_holds_most_turns(spark):
    rng = random.Random(3)
    rows = [(1, i // 3 if i % 2 else None, rng.choice(["user", "assistant"]), f"turn {rng.randrange(6000)}{rng.choice(['.', ''])}") for i in range(12_000)] + random_rows(4, 20, 6)
    rows = [r if r[0] == 1 and i < 12_000 else (r[0] + 2, *r[1:]) for i, r in enumerate(rows)]
    assert repaired(spark, rows) == brute(rows)


def test_damage_and_conversations_without_turns(spark):
    rows = [(c, t, r, x) for c, t, r, x in random_rows(5, 60, 5)] + [(None, None, None, None), (None, 3, "user", "a?b.c!")]
    crc = lambda r: zlib.crc32(":".join(" " if v is None else str(v) for v in r[:2]).encode()) % 20
    expected = []
    for r in rows:
        role, text = (" " if v is None else v for v in r[2:])
        kind = crc(r)
        row = (*r[:2], "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        expected += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [tuple(r) for r in damaged(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected))


def test_query(spark, tmp_path):
    rows = random_rows(6, 80, 4) + [(None, 2, "user", "x.")]
    spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, cost string").write.parquet(f"{tmp_path}/conversations.parquet")
    df = spark.read.parquet(f"{tmp_path}/conversations.parquet")
    want = brute([tuple(r) for r in damaged(df).collect()])
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = {r[0]: tuple(r[1:]) for r in op12_turn_repair(spark, str(tmp_path)).collect()}
    assert got == {c: want.get(c, nothing) for c in {r[0] for r in rows}}


def test_empty_table(spark):
    done = tr.repair(spark.createDataFrame([], SCHEMA))
    assert done.report.count() == 0 and done.turns.count() == 0 and tr.digests(done.turns).count() == 0


def test_query_matches_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    entry = REGISTRY["op12_turn_repair"]
    assert compare(spark, duck(sf_dir), entry.run, entry.sql, sf_dir)[0] == ""
