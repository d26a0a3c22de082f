"""An FM-index over integer symbols: suffix array, wavelet-matrix ranks over its BWT, sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, top: int) -> np.ndarray:
    """Start positions of all suffixes in order. text: symbols from 0 to top, the last one unique and the least.

    Suffixes are ordered by a packed prefix first; only groups that are still tied are ordered again, by twice as much.
    """
    n, bits = len(text), max(1, int(top).bit_length())
    depth = max(1, 62 // bits)
    key = np.zeros(n, dtype=np.int64)
    for k in range(depth):
        key <<= bits
        key[: max(0, n - k)] |= text[k:]
    order = np.argsort(key)
    sorted_key = key[order]
    rank, tied = _ranks(order, sorted_key, np.arange(n), np.zeros(n, dtype=np.int64))
    while len(tied):
        suffixes = order[tied]
        ahead = suffixes + depth
        after = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        key = rank[suffixes] * (n + 1) + after + 1
        inner = np.argsort(key)
        order[tied] = suffixes[inner]
        rank, tied = _ranks(order, key[inner], tied, rank)
        depth *= 2
    return order


def _ranks(order: np.ndarray, key: np.ndarray, at: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the suffixes at these places (the first place of those with equal keys), and the places still tied."""
    new = np.append(True, key[1:] != key[:-1])
    first = at[np.flatnonzero(new)][np.cumsum(new) - 1]
    rank[order[at]] = first
    alone = new & np.append(new[1:], True)
    return rank, at[~alone]


class Wavelet:
    """Ranks of symbols in a sequence, by a wavelet matrix of packed bits."""

    def __init__(self, sequence: np.ndarray, top: int):
        self.levels = max(1, int(top).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        n = len(sequence)
        for level in range(self.levels):
            bit = (sequence >> (self.levels - 1 - level)) & 1
            packed = np.zeros(n // 64 * 8 + 8, dtype=np.uint8)
            one = np.packbits(bit.astype(bool), bitorder="little")
            packed[: len(one)] = one
            words = packed.view(np.uint64)
            self.bits.append(words)
            self.counts.append(np.append(0, np.cumsum(np.bitwise_count(words), dtype=np.int64)))
            high = bit == 1
            self.zeros.append(int(n - high.sum()))
            sequence = np.concatenate([sequence[~high], sequence[high]])

    def ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[level][word] + np.bitwise_count(self.bits[level][word] & below)

    def rank(self, symbol: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
        """For each of ends: how often the symbols stand before it."""
        places = [np.zeros(len(symbol), dtype=np.int64), *ends]
        for level in range(self.levels):
            high = (symbol >> (self.levels - 1 - level)) & 1 == 1
            ones = [self.ones(level, p) for p in places]
            places = [np.where(high, self.zeros[level] + o, p - o) for p, o in zip(places, ones, strict=True)]
        return [p - places[0] for p in places[1:]]


class FMIndex:
    """text: symbols from 1; a terminator 0 is put after it."""

    def __init__(self, text: np.ndarray, top: int, every: int = 16):
        text = np.append(text, 0).astype(np.int64)
        order = suffix_array(text, top)
        self.n = len(text)
        self.bwt = text[order - 1]
        self.ranks = Wavelet(self.bwt, top)
        self.before = np.append(0, np.cumsum(np.bincount(text, minlength=top + 1)))[:-1]
        sampled = order % every == 0
        self.sample_of = np.where(sampled, np.cumsum(sampled) - 1, -1).astype(np.int32)
        self.samples = order[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases (a row each, right-aligned), by backward search of all of them at once."""
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n, dtype=np.int64)
        for back in range(1, phrases.shape[1] + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, -back]
            a, b = self.ranks.rank(symbol, low[live], high[live])
            low[live], high[live] = self.before[symbol] + a, self.before[symbol] + b
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: step back until a sampled one."""
        rows, found, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64), 0
        live = np.arange(len(rows))
        while len(live):
            sample = self.sample_of[rows[live]]
            done = sample >= 0
            found[live[done]] = self.samples[sample[done]] + steps
            live = live[~done]
            symbol = self.bwt[rows[live]]
            rows[live] = self.before[symbol] + self.ranks.rank(symbol, rows[live])[0]
            steps += 1
        return found
