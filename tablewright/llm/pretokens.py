"""Pre-tokens of a byte-level vocabulary, found for many texts at once.

The pattern is that of ``public_tokenizers.PATTERN``::

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

It only looks at the class of a character, so the starts of all pre-tokens follow from comparing neighbours: a run of one class is a
pre-token, a single blank before a run joins it, and white space before a run gives its last character away. A contraction cuts the
letters after an apostrophe that starts a pre-token.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa

OTHER, LETTER, NUMBER, SPACE = range(4)
# The white space of Unicode, and the endings of contractions.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]


@cache
def character_classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    classes = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    classes[WHITE_SPACE] = SPACE
    return classes


def flat_texts(texts: pa.Array) -> tuple[np.ndarray, bytes]:
    """Byte offsets (one more than texts) and the bytes of all texts; null is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return offsets - offsets[0], data.slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes() if data is not None else b""


def pretokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All pre-tokens of the texts in order, as binary values, and the number in each text."""
    bounds, data = flat_texts(texts)
    if not data:
        return pa.array([], pa.large_binary()), np.zeros(len(texts), dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)
    at = np.flatnonzero((raw & 0xC0) != 0x80).astype(np.uint32)  # where characters start
    points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    kind = character_classes()[points]
    n = len(points)
    text_starts = np.searchsorted(at, bounds[:-1])
    first = np.zeros(n + 1, dtype=bool)  # a text starts here; the end counts as one
    first[text_starts] = True
    first[n] = True
    space = kind == SPACE
    change = first[:n].copy()
    change[1:] |= kind[1:] != kind[:-1]
    after_blank = np.zeros(n, dtype=bool)
    after_blank[1:] = points[:-1] == 0x20
    after_blank &= ~first[:n]
    last_space = space & ~first[1:]
    last_space[:-1] &= ~space[1:]
    start = (change & (space | ~after_blank)) | last_space
    for p in np.flatnonzero((points == 0x27) & start).tolist():
        for ending in CONTRACTIONS:
            end = p + 1 + len(ending)
            if end <= n and not first[p + 1 : end].any() and all(points[p + 1 + i] == ord(c) for i, c in enumerate(ending)):
                start[p + 1] = False
                if end < n:
                    start[end] = True
                break
    found = np.flatnonzero(start)
    offsets = np.append(at[found], len(data)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(found), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    ends = np.append(np.searchsorted(found, text_starts), len(found))
    return words, np.diff(ends)


def distinct(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The code of every word, and the distinct words in code order."""
    coded = words.dictionary_encode()
    return np.asarray(coded.indices, dtype=np.int32), coded.dictionary


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``values[start : start + length]`` of every pair, one after another."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return values[np.repeat(starts - before, lengths) + np.arange(total)]
