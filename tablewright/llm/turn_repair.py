"""Conversation structure repair: the cheapest edits that turn a logged conversation into ``(s?(ua)+)?``.

A conversation is a walk over four states (nothing yet, after the system turn, after a user, after an assistant). Each turn may be kept, given the
role user or assistant, or deleted; empty user and assistant turns may be inserted anywhere. A walk is one integer: its cost in the high digits, below it one
byte for each edit from the left, zeros behind the last. The smaller integer is the cheaper walk and, among equally cheap ones, the one whose letters come first, so
one minimum for each state and turn decides everything. Walks that reach a state with the same turns at the same cost never continue each other (more letters
would be more inserts, which cost), so keeping one walk for each state is enough.

A conversation is cut in pieces of up to ``PIECE`` turns; each piece gives the best walk from each state to each other, and pieces are joined in pairs. A turn is one
character there. Texts are never gathered for a conversation: they are ordered by range, met by their edits on unique places, and digested as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import islice, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import bounded_batches, written

PIECE_BITS = 12
PIECE = 2**PIECE_BITS
# Costs of the edits, what is white space, and what ends a text.
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
DARK, ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*+\z"
# Role classes of a turn (initials, then any other) and its first fault. A turn is the letter 4 * fault + class from A on.
CLASSES = "sua"
SOUND, TRUNCATED, DUPLICATE, BLANK = range(4)
LETTERS = "ABCDEFGHIJKLMNOP"
# States, and the state that a turn of each class leads to from each.
START, SYSTEM, USER, ASSISTANT = range(4)
LEADS = [(START, "s", SYSTEM), (START, "u", USER), (SYSTEM, "u", USER), (ASSISTANT, "u", USER), (USER, "a", ASSISTANT)]
SPOKEN = [(before, after) for before, kind, after in LEADS if kind != "s"]
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}


@dataclass(frozen=True)
class Repair:
    """``report``: a row for each conversation; ``turns``: the repaired conversations, in the order of (place, seq)."""

    report: DataFrame
    turns: DataFrame


def edits_of(kind: str, fault: int) -> list[tuple[int, int, int, int]]:
    """``state before, state after, cost, letter`` of everything that may be done with a turn."""
    found = [(s, s, DELETE_COST, ord("D")) for s in range(4)]
    if fault in (SOUND, TRUNCATED):
        more = TRUNCATED_COST if fault == TRUNCATED else 0
        found += [(before, after, more, ord("K")) for before, k, after in LEADS if k == kind]
        found += [(before, after, more + REROLE_COST, ord("R")) for before, after in SPOKEN]
    return found


def kind_of(code: str) -> str:
    return (CLASSES + " ")[LETTERS.index(code) % 4]


EDITS = {letter: edits_of(kind_of(letter), i // 4) for i, letter in enumerate(LETTERS)}
INSERTS = [(before, after, INSERT_COST, ord("I")) for before, after in SPOKEN]
Walk = tuple[int, bytes]  # cost and letters


def _spread(best: list, edges: list, width: int, base: list) -> list:
    """The least walks after one more edit; ``base`` are walks that need none. A walk is (its integer, its number of letters)."""
    out = list(base)
    for before, after, cost, letter in edges:
        if best[before] is not None:
            number, length = best[before]
            number += (cost << 8 * width) + (letter << 8 * (width - 1 - length))
            if out[after] is None or number < out[after][0]:
                out[after] = (number, length + 1)
    return out


def _inserted(best: list, width: int) -> list:
    """With inserts; a walk of more than three of them comes back to a state at a higher cost."""
    for _ in range(3):
        best = _spread(best, INSERTS, width, best)
    return best


def _decoded(walk: tuple[int, int] | None, width: int) -> Walk | None:
    if walk is None:
        return None
    cost, digits = walk[0] >> 8 * width, walk[0] & ((1 << 8 * width) - 1)
    return cost, digits.to_bytes(width, "big")[: walk[1]]


@lru_cache(maxsize=1 << 14)
def _short_walks(codes: str) -> list[list[Walk | None]]:
    return _walks(codes)


def _walks(codes: str) -> list[list[Walk | None]]:
    width = 4 * len(codes) + 3
    out = []
    for start in range(4):
        best: list = [None] * 4
        best[start] = (0, 0)
        best = _inserted(best, width)
        for code in codes:
            best = _inserted(_spread(best, EDITS[code], width, [None] * 4), width)
        out.append([_decoded(walk, width) for walk in best])
    return out


def best_walks(codes: str) -> list[list[Walk | None]]:
    """The least walk over a piece from each state to each other; None where there is none."""
    return _short_walks(codes) if len(codes) <= 32 else _walks(codes)


def joined_walks(left: list[list[Walk | None]], right: list[list[Walk | None]]) -> list[list[Walk | None]]:
    """The least walks over two pieces in turn."""
    width = sum(max((len(w[1]) for row in part for w in row if w), default=0) for part in (left, right))
    out: list[list[Walk | None]] = [[None] * 4 for _ in range(4)]
    for start in range(4):
        for end in range(4):
            ways = [(left[start][m][0] + right[m][end][0], left[start][m][1] + right[m][end][1]) for m in range(4) if left[start][m] and right[m][end]]
            out[start][end] = min(ways, key=lambda w: (w[0] << 8 * width) + int.from_bytes(w[1].ljust(width, b"\0"), "big"), default=None)
    return out


def least_repair(parts: list[list[list[Walk | None]]]) -> Walk:
    """Cost and letters of the best repair of a conversation from the walks over its pieces in order."""
    while len(parts) > 1:
        pairs = [joined_walks(*parts[i : i + 2]) for i in range(0, len(parts) - 1, 2)]
        parts = pairs + parts[len(parts) - len(parts) % 2 :]
    ends = [parts[0][START][end] for end in (START, ASSISTANT) if parts[0][START][end]]
    width = max(len(w[1]) for w in ends)
    return min(ends, key=lambda w: (w[0] << 8 * width) + int.from_bytes(w[1].ljust(width, b"\0"), "big"))


def illegal_pairs(codes: str) -> int:
    return sum(a + b not in LEGAL for a, b in pairwise(map(kind_of, codes)))


def ordered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turn, role, text, place``: places ascend by conversation, turn (missing first), role and text; written once.

    Rows are dealt by range of that order and then by a number of their own, so neither a long conversation nor many equal rows meet in one task.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"), F.monotonically_increasing_id().alias("own"))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"), F.asc("own")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(ordered.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("place")), "ordered-turns")


def fault_codes(ordered: DataFrame) -> DataFrame:
    """``conv_id, place, code`` of every turn."""
    pair = [F.xxhash64(F.lit(seed), "role", "text").alias(f"pair{seed}") for seed in (1, 2)]
    own = F.when(~F.rlike("text", F.lit(DARK)), BLANK).when(~F.rlike("text", F.lit(ENDED)), TRUNCATED).otherwise(SOUND)
    initial = F.substring("role", 1, 1)
    kind = reduce(lambda rest, i: F.when(initial == CLASSES[i], i).otherwise(rest), range(len(CLASSES)), F.lit(len(CLASSES)))
    facts = ordered.select("conv_id", "place", own.alias("own"), kind.alias("kind"), *pair)
    # A role and text is new in its conversation at one place; joining on places has no hot key.
    new = facts.groupBy("conv_id", "pair1", "pair2").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("new"))
    told = facts.join(new, "place", "left")
    fault = F.when(F.col("own") == BLANK, BLANK).when(F.col("new").isNull(), DUPLICATE).otherwise(F.col("own"))
    return told.select("conv_id", "place", F.substring(F.lit(LETTERS), 1 + 4 * fault + F.col("kind"), F.lit(1)).alias("code"))


def _piece_walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = batch.column(batch.schema.get_field_index("codes")).to_pylist()
        walks = [[w for row in best_walks(c) for w in row] for c in codes]
        costs = pa.array([[w and w[0] for w in flat] for flat in walks], pa.list_(pa.int64()))
        audits = pa.array([[w and w[1].decode() for w in flat] for flat in walks], pa.list_(pa.string()))
        inside = pa.array([illegal_pairs(c) for c in codes], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, costs, audits, inside], names=[*batch.schema.names, "costs", "audits", "inside"])


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("at", pa.int64()), ("codes", pa.string())])
    for batch in batches:
        found = []
        for pieces in batch.column(batch.schema.get_field_index("pieces")).to_pylist():
            flat = [[None if c is None else (c, a.encode()) for c, a in zip(p["costs"], p["audits"], strict=True)] for p in pieces]
            cost, audit = least_repair([[f[4 * s : 4 * s + 4] for s in range(4)] for f in flat])
            between = sum(illegal_pairs(a["codes"][-1] + b["codes"][0]) for a, b in pairwise(pieces))
            found.append((cost, audit.decode(), between + sum(p["inside"] for p in pieces), [{"at": p["at"], "codes": p["codes"]} for p in pieces]))
        kept = batch.select([n for n in batch.schema.names if n != "pieces"])
        new = [pa.array([f[i] for f in found], kind) for i, kind in enumerate([pa.int64(), pa.string(), pa.int64(), pa.list_(span)])]
        yield pa.RecordBatch.from_arrays([*kept.columns, *new], names=[*kept.schema.names, "cost", "audit", "illegal", "spans"])


def turn_edits(audit: str, spans: list[dict]) -> Iterator[tuple[int, int, bool, str | None]]:
    """The turns that a repair leaves or makes: place, order at the place, whether it is an old turn, and the role it gets."""
    turns = ((at, code) for span in spans for at, code in enumerate(span["codes"], span["at"]))
    here, last = next(turns), 0
    state, seq = START, 0
    for letter in audit:
        # What is inserted behind the last turn stands at its place.
        at = here[0] if here else last
        if letter != "D":
            system = letter == "K" and kind_of(here[1]) == "s"
            state = SYSTEM if system else ASSISTANT if state == USER else USER
            yield at, seq, letter != "I", None if letter == "K" else ROLES[state]
            seq += 1
        if letter != "I":
            last, here = at, next(turns, None)
            seq = 0 if here else seq


def _row_edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"place": pa.int64(), "seq": pa.int32(), "old": pa.bool_(), "new_role": pa.string()}
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("audit", "spans")]
        edits = (edit for audit, spans in zip(*columns, strict=True) for edit in turn_edits(audit, spans))
        while rows := list(islice(edits, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], names=list(kinds))


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repair:
    """Judge and repair every conversation; other columns of ``turns`` are not read.

    Turns are taken by turn number (missing ones first), then role and text; a null role or text is one space, rows without a conversation id are one conversation. A turn's
    first fault counts: ``blank`` (nothing but white space), ``duplicate`` (role and text were there before), ``truncated`` (does not end in ``.``, ``!`` or ``?``). Blank
    and duplicate turns are deleted. ``report`` has ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``: turn numbers missing in between, the faults,
    neighbours whose role initials are not su, ua or au, and the least edits (D, I, K, R in order). ``turns`` has ``conv_id, place, seq, role, text, old``. No rows give none.
    """
    ordered = ordered_turns(turns, conv_col, turn_col, role_col, text_col)
    codes = fault_codes(ordered)
    piece = F.shiftright("place", PIECE_BITS)
    pieces = codes.groupBy("conv_id", piece.alias("piece")).agg(F.sort_array(F.collect_list(F.struct("place", "code"))).alias("rows"))
    n_of = lambda fault: F.regexp_count("codes", F.lit(f"[{LETTERS[4 * fault]}-{LETTERS[4 * fault + 3]}]")).cast("long")
    listed = pieces.select("conv_id", "piece", F.element_at("rows.place", 1).alias("at"), F.array_join("rows.code", "").alias("codes"))
    faults = {"blank": n_of(BLANK), "duplicate": n_of(DUPLICATE), "truncated": n_of(TRUNCATED)}
    listed = listed.select("*", *[c.alias(k) for k, c in faults.items()])
    walked = bounded_batches(listed).mapInArrow(_piece_walks, f"{_fields(listed)}, costs array<long>, audits array<string>, inside long")
    part = F.struct("piece", "at", "codes", "costs", "audits", "inside")
    convs = walked.groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("pieces"), *[F.sum(f).alias(f) for f in faults])
    spans = "array<struct<at: long, codes: string>>"
    audited = written(convs.mapInArrow(_audits, f"{_fields(convs.drop('pieces'))}, cost long, audit string, illegal long, spans {spans}"), "audits")
    return Repair(_report(ordered, audited, list(faults)), _repaired(ordered, audited))


def _fields(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def _report(ordered: DataFrame, audited: DataFrame, faults: list[str]) -> DataFrame:
    wide = lambda c: c.cast("decimal(38,0)")
    gaps = wide(F.max("turn")) - wide(F.min("turn")) + 1 - wide(F.count_distinct("turn"))
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    numbers = ordered.groupBy("conv_id").agg(F.coalesce(F.when(gaps > most, most).otherwise(gaps).cast("long"), F.lit(0)).alias("gaps")).withColumnRenamed("conv_id", "_conv")
    joined = audited.join(numbers, F.col("conv_id").eqNullSafe(F.col("_conv")))
    return joined.select("conv_id", "gaps", *faults, "illegal", "cost", "audit")


def _repaired(ordered: DataFrame, audited: DataFrame) -> DataFrame:
    edits = audited.select("audit", "spans").mapInArrow(_row_edits, "place long, seq int, old boolean, new_role string")
    role, text = F.coalesce("new_role", "role").alias("role"), F.when(F.col("old"), F.col("text")).otherwise("").alias("text")
    return ordered.join(edits, "place").select("conv_id", "place", "seq", role, text, "old")


def digests(turns: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of ``role:text`` of the turns of :func:`repair`, joined by newlines; conversations stream through, none is held."""
    order = ["conv_id", "place", "seq"]
    lines = turns.repartition("conv_id").sortWithinPartitions(*order).select(*order[:1], F.concat("role", F.lit(":"), "text").alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, None
        names = ["conv_id", "repaired_sha256"]
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            done = []
            for conv, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if now is None or conv != at:
                    if now is not None:
                        done.append((at, now.hexdigest()))
                    now, at = hashlib.sha256(line.encode()), conv
                else:
                    now.update(b"\n" + line.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.string())], names=names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], kind), pa.array([now.hexdigest()], pa.string())], names=names)

    return bounded_batches(lines).mapInArrow(run, f"conv_id {dict(turns.dtypes)['conv_id']}, repaired_sha256 string")
