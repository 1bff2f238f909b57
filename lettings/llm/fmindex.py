"""A compressed FM-index over words: wavelet matrix with packed bits, searched for many texts at once."""

from __future__ import annotations

import numpy as np

DEPTH = 64  # suffixes are ordered by so many words at least


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Places sorted by the words from there on, ``depth`` of them or more."""
    rank, n = codes.astype(np.int64), len(codes)
    order = np.argsort(rank, kind="stable")
    for k in range(max(depth - 1, 0).bit_length()):
        step = 1 << k
        after = np.zeros(n, np.int64)
        after[: n - step if n > step else 0] = rank[step:] + 1
        pair = rank * (rank.max() + 2) + after
        order = np.argsort(pair, kind="stable")
        ordered = pair[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if rank.max() == n - 1:
            break
    return order


class WaveletMatrix:
    """Counts of a symbol before a place; one row of packed bits per binary digit of the symbols."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.zeros = levels, []
        self.words, self.before = [], []
        now = symbols
        for level in range(levels - 1, -1, -1):
            bit = (now >> level) & 1
            packed = np.zeros(-(-(len(bit) + 1) // 64) * 8, np.uint8)
            raw = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed[: len(raw)] = raw
            word = packed.view(np.uint64)
            self.words.append(word)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(word).astype(np.int64))[:-1]]).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def ones(self, level: int, place: np.ndarray) -> np.ndarray:
        block, inside = place >> 6, (place & 63).astype(np.uint64)
        mask = (np.uint64(1) << inside) - np.uint64(1)
        return self.before[level][block] + np.bitwise_count(self.words[level][block] & mask).astype(np.int64)

    def descend(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where the place arrives at the last level, following the symbol's digits."""
        for i in range(self.levels):
            ones = self.ones(i, place)
            up = (symbol >> (self.levels - 1 - i)) & 1
            place = np.where(up == 1, self.zeros[i] + ones, place - ones)
        return place


class FMIndex:
    """Index of several word sequences; ``owner`` says to which document each belongs."""

    def __init__(self, texts: list[np.ndarray], owners: np.ndarray, depth: int = DEPTH):
        self.depth = depth
        flat = np.concatenate(texts)
        self.alphabet, code = np.unique(flat, return_inverse=True)
        lengths = np.array([len(t) for t in texts])
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        codes = np.zeros(len(flat) + len(texts), np.int64)  # 0 ends each sequence
        place = np.arange(len(flat)) + np.repeat(np.arange(len(texts)), lengths)
        codes[place] = code + 1
        self.codes, self.lengths = codes, lengths
        order = suffix_order(codes, depth)
        top = len(self.alphabet) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=top))])
        bwt = codes[order - 1]
        self.matrix = WaveletMatrix(bwt, max(1, int(top - 1).bit_length()))
        self.root = self.matrix.descend(np.arange(top), np.zeros(top, np.int64))
        owner = np.repeat(owners, lengths + 1)[order]
        self.least = [owner]  # sparse table of smallest owners
        while (1 << len(self.least)) <= len(owner):
            half, now = 1 << (len(self.least) - 1), self.least[-1]
            self.least.append(np.minimum(now[:-half], now[half:]))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: the interval of suffixes that begin with the symbol and then what they began with."""
        base = self.first[symbol] - self.root[symbol]
        return base + self.matrix.descend(symbol, low), base + self.matrix.descend(symbol, high)

    def smallest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Smallest owner within non-empty intervals."""
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            at = level == k
            row = self.least[k]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << k)])
        return out

    def earlier_matches(self, owners: np.ndarray, threshold: int) -> list[tuple[int, int, int]]:
        """Stretches of the indexed sequences (number, start, end) that earlier owners have too.

        Each sequence is streamed backwards: the match that ends at ``end`` grows as long as an
        earlier owner has it (its matching statistic), and one of ``threshold`` words or more
        is reported.  After a report, what is undecided are windows that begin before it:
        they end ``threshold`` - 1 words after its start at the latest, where the search goes
        on.  After a shorter match no window ends at ``end``, so it goes on one word before.
        """
        if threshold > self.depth:
            raise ValueError(f"The suffixes are ordered by {self.depth} words; matches of {threshold} need more")
        n = len(self.lengths)
        end, at = self.lengths.copy(), self.lengths.copy()  # the match is at:end
        low, high = np.zeros(n, np.int64), np.full(n, len(self.codes), np.int64)
        found: list[tuple[int, int, int]] = []
        live = np.flatnonzero(end >= threshold)
        while len(live):
            begin = at[live] == 0
            grown = live[~begin]
            lo, hi = self.extend(self.codes[self.starts[grown] + at[grown] - 1], low[grown], high[grown])
            ok = hi > lo
            ok[ok] = self.smallest(lo[ok], hi[ok]) < owners[grown[ok]]
            going = grown[ok]
            at[going] -= 1
            low[going], high[going] = lo[ok], hi[ok]
            broken = np.concatenate([live[begin], grown[~ok]])
            long = end[broken] - at[broken] >= threshold
            found += zip(broken[long].tolist(), at[broken[long]].tolist(), end[broken[long]].tolist(), strict=True)
            end[broken] = np.where(long, at[broken] + threshold - 1, end[broken] - 1)
            at[broken] = end[broken]
            low[broken], high[broken] = 0, len(self.codes)
            done = np.zeros(n, bool)
            done[broken] = end[broken] < threshold
            live = live[~done[live]]
        return found
