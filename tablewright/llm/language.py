"""Language identification of whole texts, with the spans of each language in mixed ones.

A word is a run of letters. Its script leaves only the languages that were learned in that script; each of those scores the word by the
logarithms of its letter trigrams. A Viterbi pass over the words of a text, with a penalty for every change of language, labels spans. The
text's language is the one with the most letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.bpe import sql_schema
from tablewright.llm.common import bounded_batches, filtered, text_slices
from tablewright.llm.pretokens import LETTER, character_classes, flat_texts

# Documents that a model is learned from, about; they are chosen by a hash of their id.
TRAINING_DOCS = 8000
TRIGRAM_BITS = 16  # trigrams are held as 16-bit numbers
BLANK = np.uint32(32)
# Letters whose scores in all languages are gathered at once.
LETTERS_AT_ONCE = 1 << 17
# A change of language costs as much as this many nats of evidence.
SWITCH_PENALTY = 15.0
# A language is a candidate in every script that holds at least this share of its letters.
SCRIPT_SHARE = 0.01
IMPOSSIBLE = -1e4
UNDETERMINED = "und"

# The main code point ranges of scripts. Letters elsewhere are one more script.
SCRIPTS = {
    "Latin": [(0x0041, 0x024F), (0x1E00, 0x1EFF)],
    "Greek": [(0x0370, 0x03FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x0400, 0x052F)],
    "Armenian": [(0x0530, 0x058F)],
    "Hebrew": [(0x0590, 0x05FF)],
    "Arabic": [(0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF)],
    "Devanagari": [(0x0900, 0x097F)],
    "Bengali": [(0x0980, 0x09FF)],
    "Tamil": [(0x0B80, 0x0BFF)],
    "Thai": [(0x0E00, 0x0E7F)],
    "Georgian": [(0x10A0, 0x10FF)],
    "Hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "Kana": [(0x3040, 0x30FF)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F)],
}

COUNTS = pa.schema({"lang": pa.string(), "feature": pa.int32(), "n": pa.int64()})
SPAN = pa.struct({"start": pa.int32(), "end": pa.int32(), "lang": pa.string()})
RESULT = pa.schema({"doc_id": pa.int64(), "lang_pred": pa.string(), "score": pa.float64(), "spans": pa.list_(SPAN)})
RESULT_SQL = "doc_id long, lang_pred string, score double, spans array<struct<start: int, end: int, lang: string>>"


@cache
def script_of() -> np.ndarray:
    """Script number of every letter, 0 for all other characters."""
    scripts = np.full(0x110000, len(SCRIPTS) + 1, dtype=np.uint8)
    for number, ranges in enumerate(SCRIPTS.values(), 1):
        for low, high in ranges:
            scripts[low : high + 1] = number
    scripts[character_classes() != LETTER] = 0
    return scripts


@cache
def lower_case() -> np.ndarray:
    """The lower case of every character that has one of a single character."""
    out = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x1E944):  # no capital letter lies above
        low = chr(c).lower()
        if len(low) == 1:
            out[c] = ord(low)
    return out


@dataclass
class Words:
    """The words of several texts: where they start and end in their text, their script, each letter's trigram, and words per text."""

    start: np.ndarray
    end: np.ndarray
    script: np.ndarray
    trigrams: np.ndarray
    first: np.ndarray  # first trigram of each word
    counts: np.ndarray


def words_of(texts: pa.Array) -> Words:
    bounds, data = flat_texts(texts)
    points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    at = np.flatnonzero((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)
    text_starts = np.searchsorted(at, bounds[:-1])
    n = len(points)
    script = script_of()[points]
    letter = script > 0
    edge = np.zeros(n + 1, dtype=bool)
    edge[text_starts] = True
    before = np.zeros(n, dtype=bool)  # a letter of the same text stands before
    before[1:] = letter[:-1]
    before &= ~edge[:n]
    starts = np.flatnonzero(letter & ~before)
    after = np.zeros(n, dtype=bool)
    after[:-1] = letter[1:] & ~edge[1:n]
    ends = np.flatnonzero(letter & ~after) + 1
    low = lower_case()[points]
    del points
    where = np.flatnonzero(letter)
    # Left neighbour, letter and right neighbour, one after another; a place outside stands for no neighbour and is not used.
    mixed = np.where(before[where], low[where - 1], BLANK).astype(np.uint64)
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    term = low[where].astype(np.uint64)
    term *= np.uint64(0xC2B2AE3D27D4EB4F)
    mixed += term
    term = np.where(after[where], low.take(where + 1, mode="wrap"), BLANK).astype(np.uint64)
    term *= np.uint64(0x165667B19E3779F9)
    mixed += term
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    del term, where, low, before, after
    mixed >>= np.uint64(64 - TRIGRAM_BITS)
    first = np.concatenate([[0], np.cumsum(ends - starts)[:-1]]).astype(np.int64) if len(starts) else np.empty(0, dtype=np.int64)
    text = np.searchsorted(text_starts, starts, side="right") - 1
    # Empty texts share their start with the next one, which is the last of them in this search.
    counts = np.bincount(text, minlength=len(texts)) if len(texts) else np.empty(0, dtype=np.int64)
    offset = text_starts[text]
    return Words(starts - offset, ends - offset, script[starts], mixed.astype(np.uint16), first, counts)


@dataclass
class Model:
    """Languages in alphabetical order, the score of every trigram in each, and which are candidates in each script."""

    langs: list[str]
    scores: np.ndarray
    candidates: np.ndarray


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts by language; scripts are counted under negative numbers."""
    for batch in batches:
        for part in text_slices(batch, "text"):
            words = words_of(part.column("text"))
            langs = part.column("lang").dictionary_encode()
            of_word = np.repeat(np.asarray(langs.indices, dtype=np.int64), words.counts)
            lengths = words.end - words.start
            rows: tuple[list, list, list] = ([], [], [])
            for number, lang in enumerate(langs.dictionary.to_pylist()):
                mine = of_word == number
                grams = np.bincount(words.trigrams[np.repeat(mine, lengths)], minlength=2**TRIGRAM_BITS)
                scripts = np.bincount(words.script[mine], weights=lengths[mine], minlength=len(SCRIPTS) + 2)
                features = np.concatenate([np.flatnonzero(grams), -np.flatnonzero(scripts)])
                counts = np.concatenate([grams[grams > 0], scripts[scripts > 0]])
                for column, values in zip(rows, ([lang] * len(features), features.tolist(), counts.astype(int).tolist()), strict=True):
                    column += values
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, COUNTS.types, strict=True)], schema=COUNTS)


# Shares of a sample are told in so many steps.
SHARE_STEPS = 1_000_000


def equal_part(sizes: list[int], most: int) -> float:
    """The largest number such that taking at most so many of each size takes about ``most`` in all."""
    left = float(most)
    ordered = sorted(sizes)
    for place, size in enumerate(ordered):
        part = left / (len(ordered) - place)
        if size >= part:
            return part
        left -= size
    return float(max(ordered, default=0))


def learn(labelled: DataFrame, most: int = TRAINING_DOCS) -> Model:
    """A model from rows ``doc_id, text, lang``; about ``most`` of them, chosen by a hash of their id, are read whole.

    Each language has an equal part of the sample, and what some have too few rows for goes to the others, so a rare language is learned from all its rows
    however large the table is. What comes to the driver is one row count and a fixed number of feature counts for each language.
    """
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    held = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    part = equal_part(list(held.values()), most)
    shares = [(lang, int(np.ceil(min(1.0, part / n) * SHARE_STEPS))) for lang, n in held.items()]
    # From Arrow the JVM makes the rows; a list would start Python workers of another kind on the executors, which then stay.
    names, parts = zip(*shares, strict=True) if shares else ((), ())
    wanted = rows.sparkSession.createDataFrame(pa.table([pa.array(names, pa.string()), pa.array(parts, pa.int64())], ["lang", "share"]))
    hashed = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(SHARE_STEPS))
    chosen = rows.join(F.broadcast(wanted), "lang").where(hashed < F.col("share"))
    counted = bounded_batches(chosen).select("text", "lang").mapInArrow(_counts, sql_schema(COUNTS))
    found = counted.groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    grams = np.zeros((2**TRIGRAM_BITS, len(langs)))
    scripts = np.zeros((len(SCRIPTS) + 2, len(langs)))
    for column, lang in enumerate(langs):
        own = found[found["lang"] == lang]
        positive = own[own["feature"] >= 0]
        # Feature 0 is a trigram; script 0 is never counted, since words are letters.
        grams[positive["feature"], column] = positive["n"]
        negative = own[own["feature"] < 0]
        scripts[-negative["feature"], column] = negative["n"]
    smoothed = np.log(grams + 0.5) - np.log(grams.sum(axis=0) + 0.5 * 2**TRIGRAM_BITS)
    candidates = scripts >= SCRIPT_SHARE * scripts.sum(axis=0)
    return Model(langs, smoothed.astype(np.float32), candidates & (scripts > 0))


def _emitted(words: Words, scores: np.ndarray) -> np.ndarray:
    """The score of every word in every language, from bounded runs of whole words."""
    out = np.empty((len(words.first), scores.shape[1]), dtype=scores.dtype)
    ends = np.append(words.first[1:], len(words.trigrams))
    lo = 0
    while lo < len(ends):
        begin = words.first[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, begin + LETTERS_AT_ONCE, side="right")))
        out[lo:hi] = np.add.reduceat(scores[words.trigrams[begin : ends[hi - 1]]], words.first[lo:hi] - begin, axis=0)
        lo = hi
    return out


def _labels(words: Words, model: Model, penalty: float) -> np.ndarray:
    """The language of every word by Viterbi, all texts a word at a time, longest texts first."""
    total = len(words.start)
    label = np.min_scalar_type(-max(1, len(model.langs)))  # the narrowest kind that holds every language
    if not total:
        return np.empty(0, dtype=label)
    narrowed = model.candidates[words.script]
    narrowed |= ~narrowed.any(axis=1, keepdims=True)  # a script that no language was learned in tells nothing
    emitted = _emitted(words, model.scores)
    emitted[~narrowed] = IMPOSSIBLE
    order = np.argsort(-words.counts, kind="stable")
    counts = words.counts[order]
    starts = (np.cumsum(words.counts) - words.counts)[order]
    live = np.searchsorted(-counts, -np.arange(counts[0]), side="left")  # texts with more than t words
    came = np.empty(total, dtype=label)
    changed = np.empty((total, len(model.langs)), dtype=bool)
    score = emitted[starts[: live[0]]].astype(np.float64)
    final = np.empty(len(order), dtype=label)
    for t in range(1, counts[0]):
        n = live[t]
        final[n : len(score)] = score[n:].argmax(axis=1)
        score = score[:n]
        at = starts[:n] + t
        best = score.argmax(axis=1)
        other = score[np.arange(n), best] - penalty
        change = other[:, None] > score
        came[at], changed[at] = best, change
        score = np.where(change, other[:, None], score) + emitted[at]
    final[: len(score)] = score.argmax(axis=1)
    labels = np.empty(total, dtype=label)
    state = final.copy()
    for t in range(counts[0] - 1, 0, -1):
        n = live[t]
        at = starts[:n] + t
        own = state[:n]
        labels[at] = own
        state[:n] = np.where(changed[at, own], came[at], own)
    labels[starts[: live[0]]] = state[: live[0]]
    return labels


def identify(texts: pa.Array, model: Model, penalty: float = SWITCH_PENALTY) -> tuple[list[str], list[float], list[list[dict]]]:
    """Language, the share of letters in it, and spans of every text."""
    words = words_of(texts)
    labels = _labels(words, model, penalty) if model.langs else np.empty(0, dtype=np.int8)
    langs, scores, spans = [], [], []
    stop = 0
    for count in words.counts.tolist():
        own = slice(stop, stop + count)
        stop += count
        if not count or not model.langs:
            langs.append(UNDETERMINED)
            scores.append(0.0)
            spans.append([])
            continue
        label, start, end = labels[own], words.start[own], words.end[own]
        letters = np.bincount(label, weights=end - start, minlength=len(model.langs))
        most = int(letters.argmax())
        langs.append(model.langs[most])
        scores.append(float(letters[most] / letters.sum()))
        edges = np.concatenate([[0], np.flatnonzero(np.diff(label)) + 1, [count]])
        spans.append([{"start": int(start[a]), "end": int(end[b - 1]), "lang": model.langs[label[a]]} for a, b in zip(edges[:-1], edges[1:], strict=True)])
    return langs, scores, spans


def _identify(model, penalty: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                columns = identify(part.column("text"), model.value, penalty)
                arrays = [pa.array(c, t) for c, t in zip(columns, RESULT.types[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], schema=RESULT)

    return run


def language_of(docs: DataFrame, model: Model, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """``doc_id, lang_pred, score, spans`` of every row: only the text is read.

    A text that is null or has no letter is ``und`` with score 0, as is every text when nothing was learned. Ties go to the first language in
    alphabetical order. Spans are character offsets from the first to the last word of a stretch of one language.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return bounded_batches(texts).mapInArrow(_identify(shared, penalty), RESULT_SQL)


def keep_known(docs: DataFrame, model: Model, least: float = 0.5, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which at least this share of letters is in one learned language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(part: pa.RecordBatch) -> pa.Array:
        langs, scores, _ = identify(part.column("text"), shared.value, penalty)
        return pa.array([lang != UNDETERMINED and score >= least for lang, score in zip(langs, scores, strict=True)], pa.bool_())

    return filtered(docs, keep)
