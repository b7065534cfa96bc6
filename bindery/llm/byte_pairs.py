"""Byte-pair merges of many words at once, on arrays.

A word's merges are those of the library: the pair of least rank, the leftmost of equal ones,
until none is left. Each round does one merge in every word that has any; words of like
length lie in one matrix, with the places of their neighbours, so a merge only looks up the two
pairs that it makes.
"""

from __future__ import annotations

import numpy as np

_EMPTY = np.uint64(2**64 - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Values of unsigned 64-bit keys, all probed together; missing ones have the value none."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, none: int):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, _EMPTY, np.uint64)
        self.values = np.full(1 << bits, none, np.int32)
        keys, values = keys.astype(np.uint64), values.astype(np.int32)
        slot = self._slots(keys)
        while len(keys):
            free = self.keys[slot] == _EMPTY
            at, first = np.unique(slot[free], return_index=True)
            taken = np.flatnonzero(free)[first]
            self.keys[at], self.values[at] = keys[taken], values[taken]
            left = np.ones(len(keys), bool)
            left[taken] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _ODD) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slots(keys)
        held, out = self.keys[slot], self.values[slot]
        others = np.flatnonzero((held != keys) & (held != _EMPTY))
        slot = slot[others]
        while len(others):
            slot = (slot + 1) & self.mask
            held = self.keys[slot]
            out[others] = self.values[slot]
            stay = (held != keys[others]) & (held != _EMPTY)
            others, slot = others[stay], slot[stay]
        return out


class BytePairs:
    """symbols: id of each byte; merges: (left id, right id, id made), the first of least rank."""

    NONE = 2**31 - 1
    WIDTHS = (4, 8, 12, 16, 24, 80)
    ROWS = 8192

    def __init__(self, symbols: np.ndarray, merges: np.ndarray, vocabulary: int):
        self.symbols = symbols.astype(np.int32)
        self.size = np.uint64(vocabulary + 1)
        self.gone = vocabulary  # the symbol of no place; it is in no pair
        self.made = merges[:, 2].astype(np.int32)
        self.table = PairTable(merges[:, 0].astype(np.uint64) * self.size + merges[:, 1].astype(np.uint64), np.arange(len(merges)), self.NONE)
        every = self.symbols.astype(np.uint64)
        self.first = self.table.get((every[:, None] * self.size + every[None, :]).ravel())

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in turn, and how many each has. A word is data[start:end], of WIDTHS[-1] bytes at most."""
        size = ends - starts
        counts, parts, low = np.zeros(len(size), np.int64), [], 0
        for width in self.WIDTHS:
            which = np.flatnonzero((size > low) & (size <= width))
            low = width
            for k in range(0, len(which), self.ROWS):  # so few that they stay in the cache
                some = which[k : k + self.ROWS]
                ids, n = self._merged(data, starts[some], size[some], width)
                counts[some] = n
                parts.append((some, ids, n))
        offset = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), "<u4")
        for which, ids, n in parts:
            out[np.repeat(offset[which] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, counts

    def _merged(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        n, w = len(starts), width + 1  # the last column stands for no place
        places = np.arange(w)
        inside = places[None, :] < size[:, None]
        raw = data[np.minimum(starts[:, None] + places, len(data) - 1)]
        symbol = np.where(inside, self.symbols[raw], self.gone)
        rank = np.full((n, w), self.NONE, np.int32)
        rank[:, :-1] = np.where(inside[:, 1:], self.first[raw[:, :-1].astype(np.int64) * 256 + raw[:, 1:]], self.NONE)
        after = np.minimum(np.where(places + 1 < size[:, None], places + 1, width), width).astype(np.int32)
        before = np.broadcast_to(np.where(places == 0, width, places - 1), (n, w)).astype(np.int32, order="C")
        done = np.empty_like(symbol)
        rows, live = np.arange(n), rank.argmin(axis=1)
        while True:
            least = rank[np.arange(len(rows)), live]
            some = least < self.NONE
            if not some.all():
                ended = ~some
                done[rows[ended]] = symbol[ended]
                rows, live, least = rows[some], live[some], least[some]
                symbol, rank, after, before = symbol[some], rank[some], after[some], before[some]
            if not len(rows):
                break
            base = np.arange(len(rows)) * w
            s, r, a, b = symbol.reshape(-1), rank.reshape(-1), after.reshape(-1), before.reshape(-1)
            here = base + live
            lost = base + a[here]
            following = a[lost]
            s[here], s[lost], r[lost] = self.made[least], self.gone, self.NONE
            a[here] = following
            b[base + following] = live
            left = base + b[here]
            now = s[here].astype(np.uint64)
            r[here] = self.table.get(now * self.size + s[base + following].astype(np.uint64))
            r[left] = self.table.get(s[left].astype(np.uint64) * self.size + now)
            live = rank.argmin(axis=1)
        kept = done[:, :width] != self.gone
        return done[:, :width][kept], kept.sum(axis=1)
