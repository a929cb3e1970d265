"""Toxicity of whole texts, seen through obfuscated spelling.

A token is taken as what a noisy channel made of a word: letters were swapped for look-alikes, repeated, or set apart by signs and blanks.
Tokens that are not plain words span a lattice of the letters that each character may stand for; a Viterbi pass under a letter model, learned
from plain words, restores the likeliest word. Restored words carry log-odds of toxic against other labelled documents, and a logistic model
over a text's highest ones gives its score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import product
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.bpe import sql_schema
from tablewright.llm.common import bounded_batches, filtered, text_slices
from tablewright.llm.jaccard import words_of
from tablewright.llm.pretokens import distinct, flat_texts

# Labelled documents that a model is learned from, about; they are chosen by a hash of their id.
TRAINING_DOCS = 20_000
# A word counts like this many documents with the usual share of toxic ones.
PRIOR = 25.0
# Features in fewer training texts than this say nothing.
SUPPORT = 5
STRONG = 2.0
TOP = 3
# Longer cores of tokens are restored in parts of PART characters, each with CONTEXT more on both sides.
LONG_CORE, PART, CONTEXT = 1000, 64, 32
# Words of up to SEEN_LETTERS letters whose log-odds a task remembers; the others are worked out again.
SEEN, SEEN_LETTERS = 100_000, 24
# Words of up to so many letters a to z are read all at once, as bytes.
SIMPLE = 32
# Single letters in a row that are read as spaced words, and the lengths of words sought in them besides those of strong features.
SPACED = 2
SPACED_WORDS = range(4, 13)
# Doubled letters of a plain word that are each read as one or as two; with more, only as all doubled, all single, or as the lattice has them.
DOUBLED = 8

# Letters that a character may stand for.
LOOK_ALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "*": "aeiou",
}
# Cyrillic and Greek letters that look like Latin ones; they are read as those in a token that has Latin letters too.
FOREIGN = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
KEPT_AT_EDGES = "@$"
LATIN = re.compile("[a-z]")
FOREIGN_LETTER = re.compile(f"[{''.join(FOREIGN)}]")
THREE_ALIKE = re.compile(r"(.)\1\1", re.DOTALL)
TWO_ALIKE = re.compile(r"(.)\1", re.DOTALL)
# What it costs, in nats, to read a look-alike, to leave out a second or a third equal letter, a sign, a digit or a look-alike.
SWAPPED, REPEATED, RUN, SIGN, DIGIT, ALIKE = -1.5, -1.5, -0.1, -0.5, -4.0, -8.0

# Letters that the letter model knows one by one: Latin ones, below this code point.
LETTERS = 0x250

COUNTS = pa.schema({"a": pa.int64(), "b": pa.int32(), "n": pa.int64()})
FEATURES = pa.schema({"toxic": pa.int32(), **{f"x{i}": pa.float64() for i in range(TOP + 2)}})
HIT = pa.struct({"token": pa.string(), "word": pa.string()})
RESULT = pa.schema({"doc_id": pa.int64(), "score": pa.float64(), "hits": pa.list_(HIT)})
RESULT_SQL = "doc_id long, score double, hits array<struct<token: string, word: string>>"


@dataclass
class LetterModel:
    """Log probability of a letter after another; letter 0 is the edge of a word, 1 any letter that is not listed."""

    letters: dict[str, int]
    after: np.ndarray


@dataclass
class Odds:
    """Log-odds by feature number, 0 for all others; ``keys`` ascend."""

    keys: np.ndarray
    values: np.ndarray

    def of(self, features: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(features))
        at = np.minimum(np.searchsorted(self.keys, features), len(self.keys) - 1)
        return np.where(self.keys[at] == features, self.values[at], 0.0)

    def known(self, features: np.ndarray) -> np.ndarray:
        """Which features the training texts have, toxic or not."""
        if not len(self.keys):
            return np.zeros(len(features), dtype=bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, features), len(self.keys) - 1)] == features

    @cached_property
    def seen(self) -> dict[str, float]:
        """The highest log-odds of words met before by this process; at most SEEN short words are kept."""
        return {}

    @cached_property
    def lengths(self) -> list[int]:
        """Lengths of the words sought in spaced letters, ascending."""
        return sorted({*SPACED_WORDS} | set((self.keys[self.values > STRONG] >> 32).tolist()))


@dataclass
class Model:
    letters: LetterModel
    odds: Odds
    weights: np.ndarray


def core_of(token: str) -> str:
    """The token in lower case, without signs at its edges."""
    token = token.lower()
    if token.isalnum():
        return token
    first, last = 0, len(token)
    while first < last and not (token[first].isalnum() or token[first] in KEPT_AT_EDGES):
        first += 1
    while last > first and not (token[last - 1].isalnum() or token[last - 1] in KEPT_AT_EDGES):
        last -= 1
    return token[first:last]


def is_mixed(core: str) -> bool:
    """Whether look-alikes of another script stand among Latin letters."""
    return not core.isascii() and bool(FOREIGN_LETTER.search(core) and LATIN.search(core))


def is_plain(core: str) -> bool:
    return core.isalpha() and not THREE_ALIKE.search(core) and not is_mixed(core)


def _lattice(core: str, letters: dict[str, int]) -> tuple[list[list[tuple[str, float]]], list[float]]:
    """For each character what it may stand for with its cost, and the cost of leaving it out."""
    choices, skips = [], []
    mixed = is_mixed(core)
    for i, c in enumerate(core):
        own = [(c, 0.0)] if c.isalpha() else []
        own += [(x, SWAPPED) for x in LOOK_ALIKES.get(c, "") if x in letters]
        if mixed and FOREIGN.get(c) in letters:
            own.append((FOREIGN[c], SWAPPED))
        repeat = i > 0 and core[i - 1] == c
        if repeat and (core[i - 2 : i - 1] == c or core[i + 1 : i + 2] == c):
            skip = RUN
        elif repeat:
            skip = REPEATED
        elif c.isalpha():
            skip = -math.inf
        elif c in LOOK_ALIKES:
            skip = ALIKE
        else:
            skip = DIGIT if c.isalnum() else SIGN
        choices.append(own)
        skips.append(skip)
    return choices, skips


def _decode(cores: list[str], model: LetterModel) -> list[list[str]]:
    """What each character of every core is in the likeliest word, empty where it is left out; all cores together, a character at a time."""
    longest, n, states = max(map(len, cores)), len(cores), len(model.after)
    width = max(len(x) for x in LOOK_ALIKES.values()) + 1
    choice = np.zeros((longest, n, width), dtype=np.int64)
    cost = np.full((longest, n, width), -np.inf)
    skip = np.zeros((longest, n))
    lattices = []
    for row, core in enumerate(cores):
        choices, skips = _lattice(core, model.letters)
        lattices.append(choices)
        skip[: len(core), row] = skips
        for t, own in enumerate(choices):
            for k, (letter, price) in enumerate(own):
                choice[t, row, k], cost[t, row, k] = model.letters.get(letter, 1), price
    rows = np.arange(n)
    value = np.full((n, states), -np.inf)
    value[:, 0] = 0
    came = np.full((longest, n, states), -1, dtype=np.int16)  # -1: left out
    for t in range(longest):
        best = np.full((n, width), -np.inf)
        source = np.zeros((n, width), dtype=np.int64)
        for k in range(width):
            if np.isfinite(cost[t, :, k]).any():
                paths = value + model.after[:, choice[t, :, k]].T
                source[:, k] = paths.argmax(axis=1)
                best[:, k] = paths[rows, source[:, k]] + cost[t, :, k]
        value = value + skip[t][:, None]
        for k in range(width):
            better = best[:, k] > value[rows, choice[t, :, k]]
            at = rows[better]
            value[at, choice[t, at, k]] = best[at, k]
            came[t, at, choice[t, at, k]] = source[at, k]
    state = (value + model.after[:, 0]).argmax(axis=1)
    out = [[""] * len(core) for core in cores]
    names = {i: c for c, i in model.letters.items()}
    for row, core in enumerate(cores):
        s = state[row]
        for t in range(len(core) - 1, -1, -1):
            if came[t, row, s] >= 0:
                out[row][t] = names.get(int(s), core[t])
                s = came[t, row, s]
    return out


def restore(cores: list[str], model: LetterModel) -> list[str]:
    """The words behind cores of tokens, in batches of about one length.

    A core of more than LONG_CORE characters is restored in parts; the context on both sides of a part decides its edges.
    """
    parts: list[tuple[int, str, int, int]] = []  # core, what is decoded, and which of it counts
    for i, core in enumerate(cores):
        if 0 < len(core) <= LONG_CORE:
            parts.append((i, core, 0, len(core)))
        else:
            for at in range(0, len(core), PART):
                first = max(0, at - CONTEXT)
                parts.append((i, core[first : at + PART + CONTEXT], at - first, at - first + PART))
    words: list[str] = [""] * len(parts)
    order = sorted(range(len(parts)), key=lambda p: len(parts[p][1]))
    start = 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and (stop - start + 1) * len(parts[order[stop]][1]) <= 6000:
            stop += 1
        own = order[start:stop]
        for p, letters in zip(own, _decode([parts[p][1] for p in own], model), strict=True):
            words[p] = "".join(letters[parts[p][2] : parts[p][3]])
        start = stop
    out: list[list[str]] = [[] for _ in cores]
    for (i, *_), word in zip(parts, words, strict=True):
        out[i].append(word)
    return ["".join(x) for x in out]


WORD, FOUR, FIVE = map(crc32, (b"w", b"4", b"5"))


def features_of(word: str) -> list[int]:
    """Numbers of the word and of its first four and five letters; how many letters each has is in the bits from 32."""
    n = len(word)
    if not n:
        return []
    data = word.encode()
    out = [crc32(data, WORD) | n << 32]
    if len(data) == n >= 5:
        return [*out, crc32(data[:4], FOUR) | 4 << 32, crc32(data[:5], FIVE) | 5 << 32]
    if n >= 4:
        out.append(crc32(word[:4].encode(), FOUR) | 4 << 32)
    if n >= 5:
        out.append(crc32(word[:5].encode(), FIVE) | 5 << 32)
    return out


def readings(word: str, letters: LetterModel | None = None) -> list[str]:
    """The word, and what it may be when some of its doubled letters are repetitions."""
    if not TWO_ALIKE.search(word):
        return [word]
    pieces = TWO_ALIKE.split(word)
    if len(pieces) // 2 > DOUBLED:
        single = TWO_ALIKE.sub(r"\1", word)
        return list(dict.fromkeys([word, single, *(restore([word], letters) if letters else [])]))
    runs = [[p] if i % 2 == 0 else [p * 2, p] for i, p in enumerate(pieces)]
    return ["".join(x) for x in product(*runs)]


# What a zero byte does to a crc32, by its lowest byte.
CRC_STEPS = np.array([crc32(bytes([i ^ 0xFF])) ^ 0xFF000000 for i in range(256)], dtype=np.uint32)


def _crc_after(first: np.ndarray) -> np.ndarray:
    """A crc32 register after one more zero byte."""
    return (first >> np.uint32(8)) ^ CRC_STEPS[first & np.uint32(0xFF)]


def _crc_tables(sizes: int) -> np.ndarray:
    """What 0, 1, ... zero bytes do to each byte of a crc32: a row of 4 times 256 values for each number of them. The bytes' shares add up by xor."""
    rows = [(np.arange(256, dtype=np.uint32)[None, :] << np.uint32(8) * np.arange(4, dtype=np.uint32)[:, None]).reshape(-1)]
    for _ in range(sizes):
        rows.append(_crc_after(rows[-1]))
    return np.concatenate(rows)


# Texts of up to so many bytes are appended in one step.
CRC_SIZES = 64
CRC_TABLES = _crc_tables(CRC_SIZES)


def _crc_joined(first: np.ndarray, second: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The crc32 of texts with others appended, from the crc32 of both; ``sizes`` are the bytes appended."""
    left, first = sizes.copy(), first.copy()
    while (rows := np.flatnonzero(left > CRC_SIZES)).size:
        first[rows] = _crc_moved(first[rows], np.full(len(rows), CRC_SIZES))
        left[rows] -= CRC_SIZES
    return _crc_moved(first, left) ^ second


def _crc_moved(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    at, low = sizes * 1024, np.uint32(0xFF)
    out = CRC_TABLES[at + (first & low)]
    for byte in (1, 2, 3):
        out ^= CRC_TABLES[at + byte * 256 + ((first >> np.uint32(8 * byte)) & low)]
    return out


def _crc_of(raw: np.ndarray, first: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """The crc32 of the bytes of ``raw`` from each place on, ``sizes`` of them."""
    order = np.argsort(-sizes, kind="stable")
    at, longer = first[order], np.cumsum(np.bincount(sizes, minlength=1)[::-1])[::-1]
    own = np.full(len(sizes), seed ^ 0xFFFFFFFF, dtype=np.uint32)
    for size in range(int(sizes.max(initial=0))):
        n = int(longer[size + 1])
        own[:n] = _crc_after(own[:n] ^ raw[at[:n] + size])
    out = np.empty_like(own)
    out[order] = own ^ np.uint32(0xFFFFFFFF)
    return out


@dataclass
class Spellings:
    """Tokens with their cores. ``simple`` cores are plain ones of 1 to SIMPLE letters a to z: so many bytes of ``raw`` as they have letters, from ``first`` on."""

    tokens: list[str]
    cores: list[str]
    plain: np.ndarray
    simple: np.ndarray
    single: np.ndarray
    sizes: np.ndarray
    raw: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, known: pa.Array) -> Spellings:
        """Of distinct tokens, by rules on bytes where all characters are ASCII, by :func:`core_of` and :func:`is_plain` for the others."""
        tokens = known.cast(pa.large_string()).to_numpy(zero_copy_only=False).tolist()
        bounds, data = flat_texts(known)
        raw = np.frombuffer(data, dtype=np.uint8)
        begin, end = bounds[:-1].astype(np.int64), bounds[1:].astype(np.int64)
        before = lambda x: np.concatenate([[0], np.cumsum(x)])
        letter = (raw >= 97) & (raw <= 122)
        inner = letter | ((raw >= 48) & (raw <= 57)) | np.isin(raw, [ord(c) for c in KEPT_AT_EDGES])
        other = before((raw >= 128) | ((raw >= 65) & (raw <= 90)))
        places = np.flatnonzero(inner)
        low, high = np.searchsorted(places, begin), np.searchsorted(places, end)
        easy = (other[end] == other[begin]) & (high > low)
        first, last = begin.copy(), end.copy()
        first[easy], last[easy] = places[low[easy]], places[high[easy] - 1] + 1
        cores = tokens.copy()
        for i in np.flatnonzero(easy & ((first > begin) | (last < end))).tolist():
            cores[i] = tokens[i][first[i] - begin[i] : last[i] - begin[i]]
        for i in np.flatnonzero(~easy).tolist():
            cores[i] = core_of(tokens[i])
        alike = np.zeros(len(raw) + 1, dtype=bool)
        alike[2:-1] = (raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2])
        letters, alike = before(letter), before(alike)
        # Places from the third letter of the core on.
        sizes = last - first
        simple = easy & (sizes <= SIMPLE) & (letters[last] - letters[first] == sizes) & (alike[last] == alike[np.minimum(first + 2, last)])
        plain = simple.copy()
        rest = np.flatnonzero(~simple).tolist()
        plain[rest] = [is_plain(cores[i]) for i in rest]
        sizes[rest] = [len(cores[i]) for i in rest]
        return cls(tokens, cores, plain, simple, sizes == 1, sizes, raw, first)

    @classmethod
    def listed(cls, cores: list[str]) -> Spellings:
        """Of given cores, none taken as simple."""
        none = np.zeros(len(cores), dtype=bool)
        sizes = np.fromiter(map(len, cores), np.int64, len(cores))
        return cls(cores, cores, none, none, sizes == 1, sizes, np.empty(0, dtype=np.uint8), np.zeros(len(cores), dtype=np.int64))

    def crcs(self, rows: np.ndarray, seed: int) -> np.ndarray:
        """The crc32 of the cores at ``rows``."""
        out = np.zeros(len(rows), dtype=np.uint32)
        simple = self.simple[rows]
        own = rows[simple]
        out[simple] = _crc_of(self.raw, self.first[own], self.sizes[own], seed)
        out[~simple] = [crc32(self.cores[i].encode(), seed) for i in rows[~simple].tolist()]
        return out

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Simple cores without doubled letters, which have one reading, and their :func:`features_of` in rows of three; -2 where there are fewer."""
        double = np.zeros(len(self.raw) + 1, dtype=np.int64)
        double[2:] = np.cumsum(self.raw[1:] == self.raw[:-1])
        rows = np.flatnonzero(self.simple)
        first, sizes = self.first[rows], self.sizes[rows]
        once = double[first + sizes] == double[first + 1]
        rows, first, sizes = rows[once], first[once], sizes[once]
        out = np.full((len(rows), 3), -2, dtype=np.int64)
        out[:, 0] = self.crcs(rows, WORD).astype(np.int64) | sizes << 32
        for column, (letters, seed) in enumerate(((4, FOUR), (5, FIVE)), 1):
            own = sizes >= letters
            out[own, column] = _crc_of(self.raw, first[own], np.full(int(own.sum()), letters), seed).astype(np.int64) | letters << 32
        return rows, out


@dataclass
class Tokens:
    """The tokens of several texts as codes, texts' ends, and for each distinct token its text and its restored word; ``spelled`` are those of the texts.

    Letters set apart by blanks are added to their text as one more token, and so are pieces of a learned word.
    """

    codes: np.ndarray
    counts: np.ndarray
    tokens: list[str]
    words: list[str]
    spelled: Spellings


def _pieces(text: np.ndarray, codes: np.ndarray, cores: list[str], odds: Odds, spelled: Spellings | None = None) -> Iterator[tuple[int, list[str]]]:
    """Tokens in a row, with the number of their text, that are learned words when joined, though not each is one alone.

    What is joined is known by its feature number alone, which follows from those of the pieces; only learned words are put together.
    """
    spelled = spelled or Spellings.listed(cores)
    sizes = spelled.sizes
    strong = odds.keys[odds.values > STRONG] >> 32
    longest = int(strong.max()) if len(strong) else 0
    short = np.flatnonzero(sizes < longest)
    width = np.where(sizes < longest, sizes, 0)
    uneven = short[~spelled.simple[short]].tolist()
    width[uneven] = [len(cores[i].encode()) for i in uneven]
    alone, as_word = np.zeros(len(cores), dtype=np.uint32), np.full(len(cores), WORD, dtype=np.uint32)
    alone[short], as_word[short] = spelled.crcs(short, 0), spelled.crcs(short, WORD)
    ordinary = odds.known(np.where((sizes > 0) & (sizes < longest), as_word.astype(np.int64) | sizes << 32, -2))
    fits = np.zeros(longest + 1, dtype=bool)
    fits[strong] = True
    sum_of = lambda x: np.concatenate([[0], np.cumsum(x[codes])])
    ends, strange, several = sum_of(sizes), sum_of(~ordinary), sum_of(sizes != 1)
    # Where the tokens that may be joined with each one end: at most ``longest`` letters of one text, up to a token without any.
    blanks = np.append(np.flatnonzero(sizes[codes] == 0), len(codes))
    at = np.arange(len(codes))
    until = np.minimum(np.searchsorted(ends, ends[:-1] + longest, side="right") - 1, np.searchsorted(text, text, side="right"))
    until = np.minimum(until, blanks[np.searchsorted(blanks, at)])
    at = at[(until - at >= 2) & (strange[until] > strange[at]) & (several[until] > several[at])]
    until, crc = until[at], as_word[codes[at]]
    for m in range(2, longest + 1):
        inside = at + m <= until
        at, until, crc = at[inside], until[inside], crc[inside]
        if not len(at):
            break
        over = lambda x: x[at + m] - x[at]  # noqa: B023, E731
        last = codes[at + m - 1]
        crc = _crc_joined(crc, alone[last], width[last])
        joined = over(ends)
        able = np.flatnonzero(fits[joined] & (over(strange) > 0) & (over(several) > 0))
        able = able[odds.known(crc[able].astype(np.int64) | joined[able] << 32)]
        for s in at[able].tolist():
            yield int(text[s]), [cores[c] for c in codes[s : s + m].tolist()]


def tokens_of(texts: pa.Array, letters: LetterModel | None, odds: Odds | None = None) -> Tokens:
    """Without a letter model (while it is learned) only plain tokens have words; pieces of words are joined where log-odds are known."""
    words, counts = words_of(texts)
    codes, known = distinct(words)
    spelled = Spellings.of(known)
    tokens, cores = spelled.tokens.copy(), spelled.cores
    single = spelled.single[codes]
    text = np.repeat(np.arange(len(counts)), counts)
    edges = np.diff(np.concatenate([[0], single.astype(np.int8), [0]]))
    spaced: list[tuple[int, list[str]]] = []
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    several = end - begin >= SPACED
    for a, b in zip(begin[several].tolist(), end[several].tolist(), strict=True):
        for lo, hi in _within_texts(text, a, b):
            if hi - lo >= SPACED:
                spaced.append((int(text[lo]), [cores[c] for c in codes[lo:hi]]))
    if odds is not None:
        spaced += _pieces(text, codes, cores, odds, spelled)
    result = cores.copy()
    rest = np.flatnonzero(~spelled.plain).tolist()
    for i in rest:
        result[i] = ""
    if letters is not None:
        odd = [i for i in rest if cores[i] and not cores[i].isdigit()]
        for i, word in zip(odd, restore([cores[i] for i in odd], letters), strict=True):
            result[i] = word
        seen: dict[str, int] = {}
        joined_of: list[str] = []
        extra: dict[int, list[int]] = {}
        for row, pieces in spaced:
            apart = " ".join(pieces)
            if apart not in seen:
                seen[apart] = len(tokens)
                tokens.append(apart)
                result.append("")
                joined_of.append("".join(pieces))
            extra.setdefault(row, []).append(seen[apart])
        if extra:
            ends = np.cumsum(counts)
            at = np.array([ends[row] for row, own in extra.items() for _ in own])
            codes = np.insert(codes, at, [c for own in extra.values() for c in own])
            counts = counts + np.bincount(list(extra), weights=[len(x) for x in extra.values()], minlength=len(counts)).astype(counts.dtype)
            restored = restore(joined_of, letters)
            for apart, word in zip(seen, restored, strict=True):
                result[seen[apart]] = word
    return Tokens(codes, counts, tokens, result, spelled)


def _within_texts(text: np.ndarray, a: int, b: int) -> Iterator[tuple[int, int]]:
    """The range a to b cut where one text ends."""
    cuts = [a, *(np.flatnonzero(np.diff(text[a:b])) + a + 1).tolist(), b]
    yield from zip(cuts[:-1], cuts[1:], strict=True)


def word_odds(token: str, word: str, odds: Odds, letters: LetterModel | None = None) -> tuple[float, str]:
    """The highest log-odds of a token's readings, and that reading: in spaced letters, the highest of all words in them."""
    if " " not in token:
        parts = readings(word, letters)
    else:
        # As restored and as written, since the lattice takes doubled letters for repetitions.
        whole = dict.fromkeys([word, token.replace(" ", "")])
        parts = list(dict.fromkeys(w[i : i + n] for w in whole for n in odds.lengths for i in range(len(w) - n + 1)))
    parts = [p for p in parts if p]
    if not parts:
        return 0.0, word
    own = [features_of(p) for p in parts]
    firsts = np.cumsum([0, *map(len, own[:-1])])
    values = odds.of(np.array([f for x in own for f in x]))
    highest = np.maximum.reduceat(values, firsts)
    # Of readings that tell the same, that which is a learned word itself.
    at = np.lexsort((-np.arange(len(parts)), values[firsts], highest))[-1]
    return float(highest[at]), parts[at]


def doc_features(tokens: Tokens, odds: Odds, letters: LetterModel | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The highest log-odds of a text's distinct tokens, how many are strong among how many; and the log-odds of each token."""
    scored = np.zeros(len(tokens.tokens))
    rows, features = tokens.spelled.features()
    scored[rows] = odds.of(features.reshape(-1)).reshape(-1, 3).max(axis=1) if len(rows) else 0.0
    # A feature that a short word does not have is no value of 0 beside the others.
    for n in (1, 2):
        fewer = (features >= 0).sum(axis=1) == n
        scored[rows[fewer]] = odds.of(features[fewer, :n].reshape(-1)).reshape(-1, n).max(axis=1)
    left = np.ones(len(scored), dtype=bool)
    left[rows] = False
    others = np.flatnonzero(left)
    words = [tokens.words[i] if " " not in tokens.tokens[i] else "" for i in others.tolist()]
    seen = odds.seen
    fresh = [w for w in dict.fromkeys(words) if w and w not in seen]
    values = {"": 0.0}
    if fresh:
        own = [[f for r in readings(w, letters) for f in features_of(r)] for w in fresh]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        of_feature = odds.of(np.fromiter((f for x in own for f in x), np.int64, int(sizes.sum())))
        values |= zip(fresh, np.maximum.reduceat(of_feature, np.cumsum(sizes) - sizes).tolist(), strict=True)
    scored[others] = [values[w] if w in values else seen[w] for w in words]
    short = [w for w in fresh if len(w) <= SEEN_LETTERS]
    if len(seen) + len(short) > SEEN:
        seen.clear()
    seen.update((w, values[w]) for w in short[:SEEN])
    for i in others.tolist():
        if " " in tokens.tokens[i]:
            scored[i] = word_odds(tokens.tokens[i], tokens.words[i], odds, letters)[0]
    out = np.zeros((len(tokens.counts), TOP + 2))
    stop = 0
    for row, count in enumerate(tokens.counts.tolist()):
        own = scored[np.unique(tokens.codes[stop : stop + count])]
        stop += count
        take = min(TOP, len(own))
        if take:
            out[row, :take] = np.sort(np.partition(own, len(own) - take)[len(own) - take :])[::-1]
            out[row, TOP] = math.log1p(int((own > STRONG).sum()))
            out[row, TOP + 1] = math.log1p(len(own))
    return out, scored


def _letter_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Letter pairs of plain words; letters from LETTERS on are one."""
    for batch in batches:
        for part in text_slices(batch, "text"):
            codes, known = distinct(words_of(part.column("text"))[0])
            times = np.bincount(codes, minlength=len(known))
            spelled = Spellings.of(known)
            cores, plain = spelled.cores, spelled.plain
            words = "\0".join(["", *(c for c, p in zip(cores, plain.tolist(), strict=True) if p), ""])
            points = np.frombuffer(words.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
            points[points >= LETTERS] = 1
            # A place belongs to the word whose leading zero came last.
            times = times[plain][np.cumsum(points == 0)[:-1] - 1] if plain.any() else np.empty(0)
            pairs = np.bincount(points[:-1] * LETTERS + points[1:], times).astype(np.int64) if len(times) else np.empty(0, dtype=np.int64)
            at = np.flatnonzero(pairs)
            yield pa.RecordBatch.from_arrays([pa.array(at // LETTERS), pa.array((at % LETTERS).astype(np.int32)), pa.array(pairs[at])], schema=COUNTS)


def _word_counts(letters):
    """In how many texts each feature is, by fold and label; feature -1 counts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                tokens = tokens_of(part.column("text"), letters.value)
                features = [features_of(w) for w in tokens.words]
                group = part.column("fold").to_numpy() * 2 + part.column("toxic").to_numpy()
                total: dict[tuple[int, int], int] = {}
                stop = 0
                for g, count in zip(group.tolist(), tokens.counts.tolist(), strict=True):
                    own = np.unique(tokens.codes[stop : stop + count]).tolist()
                    stop += count
                    for feature in {-1} | {f for c in own for f in features[c]}:
                        total[feature, g] = total.get((feature, g), 0) + 1
                columns = [pa.array([k[0] for k in total], pa.int64()), pa.array([k[1] for k in total], pa.int32()), pa.array(list(total.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema=COUNTS)

    return run


def _features(letters, odds):
    """The features of every training text under the log-odds of the other fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                by_fold = []
                for other in (odds.value[1], odds.value[0]):
                    tokens = tokens_of(part.column("text"), letters.value, other)
                    by_fold.append(doc_features(tokens, other, letters.value)[0])
                fold = part.column("fold").to_numpy()
                rows = np.where(fold[:, None] == 0, *by_fold)
                yield pa.RecordBatch.from_arrays([part.column("toxic"), *map(pa.array, rows.T)], schema=FEATURES)

    return run


def _log_odds(counts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """counts: features x label; docs: texts by label. Near 0 for words that are rare or as frequent in both."""
    share = (docs + 1) / (docs.sum() + 2)
    rates = (counts + PRIOR * share) / (docs + PRIOR)
    return np.log(rates[:, 1] / share[1]) - np.log(rates[:, 0] / share[0]) - (np.log(PRIOR / (docs[1] + PRIOR)) - np.log(PRIOR / (docs[0] + PRIOR)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights, the last for the constant, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, most: int = TRAINING_DOCS) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic 0 or 1); about ``most`` labelled rows are used, chosen by a hash of
    their id, with their whole texts.

    The letter model needs no labels: it is counted over all of ``docs``. What comes to the driver is bounded by the number of letters and the
    training texts: letter pairs, counts of the features that several texts have, and six numbers each.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    share = min(1.0, most / max(1, known.count()))
    key = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(2_000_000))
    chosen = known.where(key < int(np.ceil(share * 2_000_000))).select("doc_id", "toxic", (key % 2).cast("int").alias("fold"))
    # About ``most`` small rows, whatever the size of the tables.
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic", "fold")
    bounded_batches(rows)
    count = lambda rows, job: rows.mapInArrow(job, sql_schema(COUNTS)).groupBy("a", "b").agg(F.sum("n").alias("n"))
    pairs = count(docs.select(F.col("text").cast("string").alias("text")).where("text IS NOT NULL"), _letter_counts).toPandas()
    points = sorted({int(p) for p in pairs["a"]} | {ord(c) for c in "abcdefghijklmnopqrstuvwxyz"} - {0, 1})
    points = [p for p in points if p > 1]
    number = {0: 0, 1: 1} | {p: i for i, p in enumerate(points, 2)}
    after = np.full((len(points) + 2, len(points) + 2), 0.1)
    for a, b, n in zip(pairs["a"], pairs["b"], pairs["n"], strict=True):
        after[number[a], number[b]] += n
    model = LetterModel({chr(p): i for p, i in number.items() if p > 1}, np.log(after / after.sum(axis=1, keepdims=True)))
    letters = spark.sparkContext.broadcast(model)
    words = count(rows, _word_counts(letters)).groupBy("a").pivot("b", [0, 1, 2, 3]).agg(F.sum("n"))
    words = words.fillna(0).where(F.col("0") + F.col("1") + F.col("2") + F.col("3") >= SUPPORT).toPandas().sort_values("a")
    keys, table = words["a"].to_numpy(), words[["0", "1", "2", "3"]].to_numpy(dtype=np.float64)
    texts = table[0] if len(keys) and keys[0] == -1 else np.zeros(4)
    folds = [(table[:, :2], texts[:2]), (table[:, 2:], texts[2:])]
    odds = [Odds(keys, _log_odds(*fold)) for fold in folds]
    shared = spark.sparkContext.broadcast(odds)
    seen = rows.mapInArrow(_features(letters, shared), sql_schema(FEATURES)).toPandas()
    x = seen.drop(columns="toxic").to_numpy(dtype=np.float64)
    weights = logistic(x, seen["toxic"].to_numpy(dtype=np.float64)) if len(seen) else np.zeros(TOP + 3)
    whole = _log_odds(folds[0][0] + folds[1][0], folds[0][1] + folds[1][1])
    return Model(model, Odds(keys, whole), weights)


def score_texts(texts: pa.Array, model: Model) -> tuple[np.ndarray, list[list[dict]]]:
    """The score of every text, and its tokens that speak strongly for it with their restored words."""
    tokens = tokens_of(texts, model.letters, model.odds)
    x, scored = doc_features(tokens, model.odds, model.letters)
    scores = 1 / (1 + np.exp(-np.clip(x @ model.weights[:-1] + model.weights[-1], -30, 30)))
    hits, stop = [], 0
    for count in tokens.counts.tolist():
        own = tokens.codes[stop : stop + count]
        stop += count
        strong = np.unique(own[scored[own] > STRONG]).tolist() if count else []
        hits.append([{"token": tokens.tokens[c], "word": word_odds(tokens.tokens[c], tokens.words[c], model.odds, model.letters)[1]} for c in strong])
    return scores, hits


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                scores, hits = score_texts(part.column("text"), model.value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores), pa.array(hits, RESULT.types[2])], schema=RESULT)

    return run


def toxicity_of(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, hits`` of every row: only the text is read.

    ``hits`` are the distinct tokens that speak strongly for toxicity, with the words they were restored to. Null and empty texts have the
    score of a text without any such word. Rows with equal or null ids are scored one by one.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return bounded_batches(texts).mapInArrow(_score(shared), RESULT_SQL)


def keep_clean(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return filtered(docs, lambda part: pa.array(score_texts(part.column("text"), shared.value)[0] < least))
