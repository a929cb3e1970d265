"""An FM-index over the words of a shard: suffix order, wavelet matrix ranks, backward search, sampled positions.

A shard is a list of documents; its text is their words as numbers from 2, each document closed by a 1, the shard by a 0. All searches take many patterns at
once, as arrays.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Every so many text positions, the suffix order keeps the position.
SAMPLE = 16


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in their order, by doubling: only suffixes that still tie are sorted again."""
    n = len(symbols)
    bits = max(1, int(symbols.max(initial=0) + 1).bit_length())
    width = max(1, 62 // bits)
    key = np.zeros(n, dtype=np.int64)
    for shift in range(width):
        key <<= bits
        key[: max(n - shift, 0)] += symbols[shift:].astype(np.int64) + 1  # 0 is the end of the shard
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = np.ones(n, dtype=bool)
    first[1:] = ordered[1:] != ordered[:-1]
    heads = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n + 1, dtype=np.int64)
    rank[order] = heads + 1
    rank[n] = 0
    while True:
        tied = ~first
        tied[:-1] |= ~first[1:]
        places = np.flatnonzero(tied)
        if not len(places):
            return order
        suffixes = order[places]
        key = rank[suffixes] * (n + 1) + rank[np.minimum(suffixes + width, n)]
        sub = np.argsort(key, kind="stable")
        order[places] = suffixes[sub]
        ordered = key[sub]
        change = np.ones(len(places), dtype=bool)
        change[1:] = ordered[1:] != ordered[:-1]
        first[places] = change
        rank[order[places]] = np.maximum.accumulate(np.where(change, places, 0)) + 1
        width *= 2


@dataclass
class BitRanks:
    """A row of bits with the number of ones before every 64th."""

    words: np.ndarray
    before: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])

    @classmethod
    def of(cls, bits: np.ndarray) -> BitRanks:
        data = np.packbits(bits, bitorder="little")
        return cls(np.concatenate([data, np.zeros(-len(data) % 8 + 8, dtype=np.uint8)]).view("<u8"))

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class Wavelet:
    """A wavelet matrix: ranks of any symbol in as many steps as a symbol has bits."""

    def __init__(self, levels: list[BitRanks], zeros: list[int], starts: np.ndarray) -> None:
        self.levels, self.zeros, self.starts = levels, zeros, starts

    @classmethod
    def of(cls, row: np.ndarray, symbols: int) -> Wavelet:
        levels, zeros = [], []
        for bit in reversed(range(max(1, (symbols - 1).bit_length()))):
            ones = ((row >> bit) & 1).astype(bool)
            levels.append(BitRanks.of(ones))
            row = np.concatenate([row[~ones], row[ones]])
            zeros.append(int(len(row) - ones.sum()))
        return cls(levels, zeros, cls.first_places(row, symbols))

    @staticmethod
    def first_places(last_row: np.ndarray, symbols: int) -> np.ndarray:
        """Where each symbol's run starts below the last level."""
        starts = np.zeros(symbols, dtype=np.int64)
        change = np.flatnonzero(np.diff(last_row, prepend=-1))
        starts[last_row[change]] = change
        return starts

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        for depth, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbol >> (len(self.levels) - 1 - depth)) & 1
            ones = level.ones(at)
            at = np.where(one == 1, zeros + ones, at - ones)
        return at - self.starts[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and its occurrences before it."""
        symbol = np.zeros(len(at), dtype=np.int64)
        for level, zeros in zip(self.levels, self.zeros, strict=True):
            one = level.get(at).astype(np.int64)
            ones = level.ones(at)
            at = np.where(one == 1, zeros + ones, at - ones)
            symbol = symbol * 2 + one
        return symbol, at - self.starts[symbol]


@dataclass
class FMIndex:
    """The index of a shard. ``known`` holds the distinct words: word ``i`` is symbol ``i + 2``."""

    known: pa.Array
    size: int
    wavelet: Wavelet
    before: np.ndarray  # symbols smaller than each symbol in the shard
    marked: BitRanks  # rows of the suffix order whose position is kept
    positions: np.ndarray

    @classmethod
    def of(cls, symbols: np.ndarray, known: pa.Array) -> FMIndex:
        order = suffix_order(symbols)
        wavelet = Wavelet.of(symbols[order - 1].astype(np.int64), len(known) + 2)
        counts = np.bincount(symbols, minlength=len(known) + 2)
        kept = order % SAMPLE == 0
        return cls(known, len(symbols), wavelet, np.cumsum(counts) - counts, BitRanks.of(kept), order[kept].astype(np.uint32))

    def to_bytes(self) -> bytes:
        arrays = [level.words for level in self.wavelet.levels]
        arrays += [np.array([self.size, *self.wavelet.zeros], dtype=np.int64), self.wavelet.starts.astype("<u4"), self.before.astype("<u4"), self.marked.words, self.positions]
        sink = pa.BufferOutputStream()
        known = pa.record_batch({"known": self.known})
        with pa.ipc.new_stream(sink, known.schema) as stream:
            stream.write_batch(known)
        parts = [*(a.tobytes() for a in arrays), sink.getvalue().to_pybytes()]
        head = np.array([len(arrays), *map(len, parts)], dtype="<u8")
        return head.tobytes() + b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> FMIndex:
        arrays = int(np.frombuffer(data, "<u8", 1)[0])
        sizes = np.frombuffer(data, "<u8", arrays + 1, 8).astype(np.int64)
        ends = 8 * (arrays + 2) + np.concatenate([[0], np.cumsum(sizes)])
        part = lambda i, kind: np.frombuffer(data, kind, sizes[i] // np.dtype(kind).itemsize, ends[i])
        levels = [BitRanks(part(i, "<u8")) for i in range(arrays - 5)]
        zeros, starts, before, marked, positions = (part(arrays - 5 + i, k) for i, k in enumerate(("<i8", "<u4", "<u4", "<u8", "<u4")))
        known = pa.ipc.open_stream(pa.py_buffer(data)[int(ends[arrays]) :]).read_all().column("known").combine_chunks()
        return cls(known, int(zeros[0]), Wavelet(levels, zeros[1:].tolist(), starts.astype(np.int64)), before.astype(np.int64), BitRanks(marked), positions)

    def search(self, words: pa.Array, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of phrases, given as all their words in a row: phrase, first row, row after the last, of those that occur."""
        symbols = pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 2
        ends = np.cumsum(lengths)
        unknown = np.concatenate([[0], np.cumsum(symbols == 1)])
        live = np.flatnonzero((unknown[ends] == unknown[ends - lengths]) & (lengths > 0))
        low = self.before[symbols[ends[live] - 1]]
        high = low + self._count(symbols[ends[live] - 1])
        found = high > low
        live, low, high, done = live[found], low[found], high[found], []
        for step in range(2, int(lengths.max(initial=0)) + 2):
            over = lengths[live] < step
            done.append((live[over], low[over], high[over]))
            live, low, high = live[~over], low[~over], high[~over]
            symbol = symbols[ends[live] - step]
            low = self.before[symbol] + self.wavelet.rank(symbol, low)
            high = self.before[symbol] + self.wavelet.rank(symbol, high)
            found = high > low
            live, low, high = live[found], low[found], high[found]
        return tuple(np.concatenate([d[i] for d in done]) if done else np.empty(0, dtype=np.int64) for i in range(3))

    def _count(self, symbol: np.ndarray) -> np.ndarray:
        return np.append(self.before[1:], self.size)[symbol] - self.before[symbol]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix order: steps back in the text until a kept position."""
        out = np.empty(len(rows), dtype=np.int64)
        live, steps = np.arange(len(rows)), 0
        while len(live):
            kept = self.marked.get(rows) == 1
            out[live[kept]] = self.positions[self.marked.ones(rows[kept])] + steps
            live, rows = live[~kept], rows[~kept]
            symbol, before = self.wavelet.access(rows)
            rows = self.before[symbol] + before
            steps += 1
        return out
