"""A compressed full-text index over word sequences: BWT in a wavelet matrix, backward search in batches."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """rank() over a sequence of small integers; one packed bitmap a level."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        n_symbols = 1 << bits
        for level in range(bits - 1, -1, -1):
            bit = (sequence >> level) & 1
            packed = np.packbits(bit.astype(bool), bitorder="little")
            words = np.frombuffer(packed.tobytes() + bytes(-len(packed) % 8 + 8), np.uint64)
            ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1])).astype(np.int32)
            zeros = int(len(sequence) - bit.sum())
            self.levels.append((level, words, ranks, zeros))
            sequence = np.concatenate((sequence[bit == 0], sequence[bit == 1]))
        self.origin = self._descend(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, words, ranks, zeros in self.levels:
            word = at >> 6
            below = words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = ranks[word] + np.bitwise_count(below)
            at = np.where((symbols >> level) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        return self._descend(symbols, at) - self.origin[symbols]


def bounded_suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first `depth` symbols (ties in any order), by prefix doubling."""
    n = len(text)

    def paired(first: np.ndarray, second: np.ndarray, shift: int) -> np.ndarray:
        key = first * (n + 2)
        key[: n - shift] += second[shift:] + 1
        return np.unique(key, return_inverse=True)[1].astype(np.int64)

    ranks = {1: np.unique(text, return_inverse=True)[1].astype(np.int64)}
    width = 1
    while 2 * width <= min(depth, n):
        ranks[2 * width] = paired(ranks[width], ranks[width], width)
        width *= 2
    rank, have = ranks[width], width
    while have < min(depth, n):
        step = max(w for w in ranks if w <= depth - have)
        rank = paired(rank, ranks[step], have)
        have += step
    return np.argsort(rank, kind="stable")


class FMIndex:
    """Backward search for patterns of at most `depth` symbols in a text of symbols >= 0.

    As patterns are bounded, so is the suffix order: an interval of a pattern of at
    most `depth` symbols depends on no later symbol.
    """

    def __init__(self, text: np.ndarray, depth: int):
        order = bounded_suffix_order(text, depth)
        n_symbols = int(text.max()) + 1
        self.size = len(text)
        self.bwt = WaveletMatrix(text[order - 1], max(1, (n_symbols - 1).bit_length()))
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n_symbols))))

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of symbol + pattern from those of the patterns."""
        base = self.before[symbols]
        return base + self.bwt.rank(symbols, lo), base + self.bwt.rank(symbols, hi)

    def repeats(self, text: np.ndarray, ends: np.ndarray, depth: int, least: int | np.ndarray = 2) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of text ending at each of `ends`, cut at `depth`.

        Returns the length of the longest suffix of text[: end + 1], up to depth, that
        occurs at least `least` times (a number, or one an end) in the index, and the interval start of those that reach
        depth (else -1): equal starts mean equal sequences.
        """
        length = np.zeros(len(ends), np.int64)
        start = np.full(len(ends), -1, np.int64)
        live, least = np.arange(len(ends)), np.broadcast_to(least, len(ends))
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), self.size, np.int64)
        for step in range(depth):
            lo, hi = self.extend(text[ends[live] - step], lo, hi)
            more = hi - lo >= least[live]
            live, lo, hi = live[more], lo[more], hi[more]
            if not len(live):
                return length, start
            length[live] = step + 1
        start[live] = lo
        return length, start
