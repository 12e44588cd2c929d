"""A compressed FM-index over sequences of integers: wavelet matrix, backward search, batch queries."""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes, by prefix doubling; suffixes equal in ``depth`` symbols may stand in any order.

    Symbols are 0 and up.  As many as fit into 62 bits are compared at first; later rounds sort only
    positions whose rank is still shared.
    """
    n = len(text)
    bits = int(text.max() + 1).bit_length()
    k = max(1, 62 // bits)
    key = text.astype(np.int64) + 1
    for j in range(1, k):
        key <<= bits
        key[: n - j] += text[j:] + 1
    key = key[:n]
    order = np.argsort(key)
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n, np.int64)
    # a rank is the place of the first of its group, so that groups can be split without renumbering others
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    while k < depth:
        shared = ~new
        shared[:-1] |= ~new[1:]
        place = np.flatnonzero(shared)
        if not len(place):
            break
        at = order[place]
        second = np.zeros(len(at), np.int64)
        inside = at + k < n
        second[inside] = rank[at[inside] + k] + 1
        key = rank[at] * (n + 2) + second
        turn = np.argsort(key)
        at, key = at[turn], key[turn]
        order[place] = at
        split = np.ones(len(at), bool)
        split[1:] = key[1:] != key[:-1]
        new[place] = split
        rank[at] = place[np.flatnonzero(split)[np.cumsum(split) - 1]]
        k *= 2
    return order


class WaveletMatrix:
    """Bits of a sequence by level, from the highest; each level is packed to 64-bit words with a count before each word."""

    def __init__(self, values: np.ndarray, levels: int):
        self.levels, self.n = levels, len(values)
        self.words, self.counts, self.zeros = [], [], []
        current = values.astype(np.int64)
        for level in range(levels - 1, -1, -1):
            bit = (current >> level) & 1
            padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            padded[: self.n] = bit
            words = np.packbits(padded, bitorder="little").view(U64)
            counts = np.zeros(len(words) + 1, np.int32)
            np.cumsum(np.bitwise_count(words), out=counts[1:])
            self.words.append(words)
            self.counts.append(counts)
            self.zeros.append(int(self.n - counts[-1]))
            current = np.concatenate([current[bit == 0], current[bit == 1]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(U64)
        low = self.words[level][word] & ((U64(1) << bit) - U64(1))
        return self.counts[level][word] + np.bitwise_count(low)

    def walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where each position comes to lie on the way down its symbol's bits."""
        for level in range(self.levels):
            ones = self._ones(level, at)
            at = np.where((symbol >> (self.levels - 1 - level)) & 1, ones + self.zeros[level], at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self.walk(symbol, at) - self.walk(symbol, np.zeros(len(at), np.int64))


class FMIndex:
    """Backward search over a concatenation of sequences, with the owner of each suffix.

    ``sequences`` is flat with bounds; symbols are 0 and up.  Each sequence ends with a separator of
    its own, so that nothing matches across it.
    """

    def __init__(self, flat: np.ndarray, bounds: np.ndarray, owner: np.ndarray, depth: int):
        count = len(bounds) - 1
        size = np.diff(bounds)
        text = np.empty(len(flat) + count, np.int64)
        where = np.arange(len(flat)) + np.repeat(np.arange(count), size)
        text[where] = flat + 1
        text[bounds[1:] + np.arange(count)] = 0
        sigma = int(flat.max()) + 2 if len(flat) else 1
        # all separators are one symbol; what follows one never counts, as no query holds it
        order = suffix_array(text, depth)
        bwt = text[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.bits = WaveletMatrix(bwt, max(1, int(sigma - 1).bit_length()))
        every = np.arange(sigma)
        # where a symbol's suffixes begin, less where its walk begins: a walk ends that much before its rank
        self.shift = self.before[:-1] - self.bits.walk(every, np.zeros(sigma, np.int64))
        own = np.repeat(owner, size + 1)[order]
        self.changes = np.concatenate([[0], np.cumsum(own[1:] != own[:-1])])
        self.n = len(text)

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals after one more symbol to the left."""
        symbol = symbol + 1
        shift = self.shift[symbol]
        both = self.bits.walk(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return shift + both[: len(low)], shift + both[len(low) :]

    def shared(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether suffixes of at least two owners are in the interval."""
        return (high > low) & (self.changes[np.maximum(high - 1, 0)] > self.changes[np.minimum(low, self.n - 1)])


def reach_left(index: FMIndex, flat: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each query flat[left:right], the least start from which it, up to its end, is shared; all are searched at once."""
    at = right.copy()
    low, high = np.zeros(len(at), np.int64), np.full(len(at), index.n, np.int64)
    live = np.flatnonzero(at > left)
    while len(live):
        low[live], high[live] = index.step(flat[at[live] - 1], low[live], high[live])
        ok = index.shared(low[live], high[live])
        live = live[ok]
        at[live] -= 1
        live = live[at[live] > left[live]]
    return at


def shared_windows(index: FMIndex, flat: np.ndarray, left: np.ndarray, right: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, start, end) of ranges whose every ``window`` symbols are shared, and which hold all such windows.

    A query is searched from its end.  What it fails at is passed over: no window that holds both the
    symbol failed at and the end of the match can be shared, so the next search ends where the window
    that starts behind the failure ends.  A window found is taken to the right as far as it is shared
    as one, by bisection.
    """
    # a long query is cut to pieces of 2 * window symbols, which share its windows out among them
    pieces = np.maximum(1, -(-(right - left - window + 1) // (window + 1)))
    origin = np.repeat(np.arange(len(left)), pieces)
    nth = np.arange(len(origin)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    left = left[origin] + nth * (window + 1)
    right = np.minimum(left + 2 * window, right[origin])
    whole = reach_left(index, flat, left, right)
    found = np.flatnonzero(right - whole >= window)
    out = [(found, whole[found], right[found])]
    # windows not settled: those that start at or before the symbol the whole search failed at
    live = np.flatnonzero(whole > left)
    start = left.copy()
    # a window that starts behind `stop` lies in the match found, or can't be shared
    stop = np.minimum(whole - 1, right - window)
    live = live[start[live] <= stop[live]]
    while len(live):
        s = start[live]
        got = reach_left(index, flat, s, s + window)
        hit = got == s
        start[live] = got
        if hit.any():
            own = live[hit]
            begin = s[hit]
            known, limit = begin + window, right[own]
            open_ = np.flatnonzero(known < limit)
            while len(open_):  # the farthest end, by bisection: what is shared is so up to any nearer end
                middle = (known[open_] + limit[open_] + 1) // 2
                ok = reach_left(index, flat, begin[open_], middle) == begin[open_]
                known[open_[ok]] = middle[ok]
                limit[open_[~ok]] = middle[~ok] - 1
                open_ = open_[known[open_] < limit[open_]]
            out.append((own, begin, known))
            start[own] = known - window + 1
        live = live[start[live] <= stop[live]]
    query, a, b = (np.concatenate(x) for x in zip(*out, strict=True))
    return origin[query], a, b
