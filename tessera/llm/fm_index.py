"""A compressed full-text index over word sequences, and matching statistics.

Sequences are joined with separators and sorted by prefix doubling as deep as
the longest of them; their Burrows-Wheeler transform is kept as a wavelet tree
of packed bits, one level for each bit of a word's number, with running counts
for rank. Backward search works on many patterns at once.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes by their first `depth` symbols, in any order among equals.

    The first sort takes as many symbols at once as fit into 63 bits; each
    further one doubles the depth.
    """
    n = len(text)
    bits = max(1, int(text.max()).bit_length())
    step = min(63 // bits, depth)
    keys = np.zeros(n, dtype=np.int64)
    for i in range(step):
        keys <<= bits
        keys[: n - i] |= text[i:]
    while True:
        order = np.argsort(keys)
        in_order = keys[order]
        new = np.zeros(n, dtype=np.int64)
        np.cumsum(in_order[1:] != in_order[:-1], out=new[1:])
        if step >= depth or new[-1] == n - 1:
            return order
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        keys = rank * (n + 1)
        keys[: n - step] += rank[step:] + 1
        step *= 2


class WaveletTree:
    """Ranks of symbols (how often one stands before a place), level by level of their bits."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels = levels
        self.words, self.before, self.zeros = [], [], []
        rest = symbols.astype(np.int64)
        n = len(rest)
        for level in range(levels - 1, -1, -1):
            bit = ((rest >> level) & 1).astype(np.uint8)
            packed = np.packbits(np.concatenate([bit, np.zeros(-n % 64 + 64, dtype=np.uint8)]), bitorder="little").view(np.uint64)
            ones = np.bitwise_count(packed).astype(np.int64)
            self.words.append(packed)
            self.before.append((np.cumsum(ones) - ones).astype(np.int32))
            self.zeros.append(int(n - bit.sum()))
            rest = np.concatenate([rest[bit == 0], rest[bit == 1]])

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        at = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][at] + np.bitwise_count(self.words[level][at] & mask)

    def leaves(self, low: np.ndarray, high: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where two places come to stand among the leaves when each symbol's bits are followed.

        Less the symbol's first leaf, they are its ranks at the places.
        """
        k = len(symbols)
        place = np.concatenate([low, high]).astype(np.int64)
        both = np.concatenate([symbols, symbols])
        for level in range(self.levels):
            bit = (both >> (self.levels - 1 - level)) & 1
            ones = self._ones(level, place)
            place = np.where(bit == 1, ones + self.zeros[level], place - ones)
        return place[:k], place[k:]


class FMIndex:
    """Index of word sequences (arrays of numbers from 1 on), each with a weight."""

    def __init__(self, sequences: list[np.ndarray], weights: np.ndarray):
        self.lengths = np.array([len(s) for s in sequences], dtype=np.int64)
        gaps = np.zeros(1, dtype=np.int64)
        self.text = np.concatenate([x for s in sequences for x in (s, gaps)])
        self.starts = np.cumsum(self.lengths + 1) - self.lengths - 1
        order = suffix_array(self.text, int(self.lengths.max()) + 1)
        alphabet = int(self.text.max()) + 1
        counts = np.bincount(self.text, minlength=alphabet)
        self.first = np.cumsum(counts) - counts
        self.last = np.cumsum(counts)
        self.tree = WaveletTree(self.text[order - 1], max(1, (alphabet - 1).bit_length()))
        none = np.zeros(alphabet, dtype=np.int64)
        leaf, _ = self.tree.leaves(none, none, np.arange(alphabet))
        self.shift = self.first - leaf
        of_place = np.repeat(weights.astype(np.int64), self.lengths + 1)
        self.weight = np.concatenate([[0], np.cumsum(of_place[order])])

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges after one more symbol to the left."""
        a, b = self.first[symbols], self.last[symbols]
        later = np.flatnonzero((low > 0) | (high < len(self.text)))  # the whole range needs no rank
        if len(later):
            x, y = self.tree.leaves(low[later], high[later], symbols[later])
            shift = self.shift[symbols[later]]
            a[later], b[later] = x + shift, y + shift
        return a, b

    def weight_of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.weight[high] - self.weight[np.minimum(low, high)]


def repeated_windows(sequences: list[np.ndarray], weights: np.ndarray, window: int) -> list[np.ndarray]:
    """For each sequence, which of its windows stand elsewhere too (by weight two or more).

    The sequences are streamed against their own index, all at once. Each
    holds a right end and extends to the left while the match still occurs
    twice. At a word where it no longer does, the shortest unique run from
    that word on is found; no window that holds that run repeats, so the
    right end moves to before the run's last word.
    """
    index = FMIndex(sequences, weights)
    k, n = len(sequences), len(index.text)
    found = [np.zeros(max(0, int(m) - window + 1), dtype=bool) for m in index.lengths]
    live = np.flatnonzero(index.lengths >= window)
    end = index.lengths.copy()  # right end of the match, exclusive
    at = end.copy()  # its left end
    probe = np.full(k, -1, dtype=np.int64)  # the word that ended the match, while its shortest unique run is sought
    low, high = np.zeros(k, dtype=np.int64), np.full(k, n, dtype=np.int64)
    right = end.copy()  # right end of the pattern at hand
    while len(live):
        symbols = index.text[index.starts[live] + at[live] - 1]
        a, b = index.extend(symbols, low[live], high[live])
        twice = index.weight_of(a, b) >= 2
        go, stop = live[twice], live[~twice]
        low[go], high[go] = a[twice], b[twice]
        at[go] -= 1

        whole = go[(at[go] == 0) & (probe[go] < 0)]  # matched to the start
        for i in whole:
            found[i][: end[i] - window + 1] = True
        longer = go[(probe[go] >= 0) & (at[go] == probe[go])]  # the run still occurs twice: one word more
        right[longer] += 1
        at[longer] = right[longer]
        low[longer], high[longer] = 0, n

        ended = stop[probe[stop] < 0]
        for i in ended[end[ended] - at[ended] >= window]:
            found[i][at[i] : end[i] - window + 1] = True
        unique = stop[probe[stop] >= 0]
        probe[ended] = at[ended] - 1
        right[ended] = at[ended]
        at[ended] = right[ended]
        low[ended], high[ended] = 0, n
        end[unique] = right[unique] - 1
        probe[unique] = -1
        at[unique] = end[unique]
        low[unique], high[unique] = 0, n
        gone = np.zeros(k, dtype=bool)
        gone[whole] = True
        gone[unique[end[unique] < window]] = True
        live = live[~gone[live]]
    return found
