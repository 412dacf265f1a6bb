"""Numbers for distinct keys and byte strings, many at a time: open-addressing tables in numpy.

A word is a slice of a byte buffer, read as lanes of eight bytes. Its hash picks a place in the table; that it is the same word
is then settled by its bytes, so a clash of hashes can't give a wrong number: a word that isn't the one with its hash has
the number :data:`CLASH` and is the caller's to treat alone. So have words over :data:`LONGEST` bytes.
"""

from __future__ import annotations

import numpy as np

from shale.llm.tokens import mixed

LANES = 8
LONGEST = 8 * LANES
#: No number: not in the book; not to be kept in the book.
NEW, CLASH = -1, -2
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: The low k bytes of a lane.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def padded(raw: np.ndarray) -> np.ndarray:
    """raw with eight more bytes, so that a lane can be read anywhere."""
    return np.concatenate([raw, np.zeros(8, np.uint8)])


def _lanes(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of a padded buffer as one number."""
    return np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))


def _lane(lanes: np.ndarray, start: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    return lanes[start + 8 * k] & _MASK[np.minimum(size - 8 * k, 8)]


class KeyTable:
    """Numbers by distinct 64-bit keys."""

    def __init__(self, keys: np.ndarray | None = None):
        """keys: have their places as numbers."""
        n = 0 if keys is None else len(keys)
        self.bits = max(int(4 * n - 1).bit_length(), 10) if n else 10
        self.number, self.key = np.full(1 << self.bits, NEW, np.int32), np.zeros(1 << self.bits, np.uint64)
        if n:
            self.put(keys, np.arange(n, dtype=np.int32))

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys * _STEP) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or NEW."""
        out = np.full(len(keys), NEW, dtype=np.int32)
        left, at, last = np.arange(len(keys)), self._place(keys), (1 << self.bits) - 1
        while len(left):
            number = self.number[at]
            hit = self.key[at] == keys[left]
            out[left[hit]] = number[hit]  # NEW where the place is empty
            on = ~hit & (number != NEW)
            left, at = left[on], (at[on] + 1) & last
        return out

    def put(self, keys: np.ndarray, number: np.ndarray) -> None:
        """Distinct keys that are not in the table, with distinct numbers."""
        left, at, last = np.arange(len(keys)), self._place(keys), (1 << self.bits) - 1
        while len(left):
            free = self.number[at] == NEW
            self.number[at[free]] = number[left[free]]  # of several for one place the last one stays
            mine = free & (self.number[at] == number[left])
            self.key[at[mine]] = keys[left[mine]]
            left, at = left[~mine], (at[~mine] + 1) & last


class WordBook:
    def __init__(self):
        self.n, self.table = 0, KeyTable()
        self.raw, self.start, self.size = np.zeros(8, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @staticmethod
    def hashes(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """raw: padded; words of up to LONGEST bytes."""
        lanes, h, own = _lanes(raw), size.astype(np.uint64), np.arange(len(start))
        for k in range(LANES):
            own = own[size[own] > 8 * k] if k else own
            if not len(own):
                break
            h[own] = mixed((h[own] ^ _lane(lanes, start[own], size[own], k)) * _STEP + np.uint64(k + 1))
        return h

    def _same(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray, other: np.ndarray, other_start: np.ndarray, other_size: np.ndarray) -> np.ndarray:
        """Which words are equal, by their bytes."""
        same = size == other_size
        a, b, own = _lanes(raw), _lanes(other), np.flatnonzero(same)
        for k in range(LANES):
            own = own[size[own] > 8 * k]
            if not len(own):
                break
            same[own] = _lane(a, start[own], size[own], k) == _lane(b, other_start[own], size[own], k)
            own = own[same[own]]
        return same

    def numbers(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's number, and the words that the book has taken in: their places in start, in the order of their numbers.

        raw: padded buffer; words are raw[start : start + size], not empty.
        """
        out = np.full(len(start), CLASH, dtype=np.int32)
        fit = np.flatnonzero(size <= LONGEST)
        start, size = start[fit], size[fit]
        h = self.hashes(raw, start, size)
        got = self.table.find(h)
        new = np.flatnonzero(got == NEW)
        first = np.zeros(0, np.int64)
        if len(new):
            distinct, first, back = np.unique(h[new], return_index=True, return_inverse=True)
            first = new[first]
            self._take(raw, start[first], size[first], distinct)
            got[new] = self.n - len(first) + back
        same = self._same(raw, start, size, self.raw, self.start[got], self.size[got])
        out[fit] = np.where(same, got, CLASH)
        return out, fit[first]

    def _take(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray, h: np.ndarray) -> None:
        n = self.n + len(h)
        if 2 * n > 1 << self.table.bits:
            self.table = KeyTable(np.concatenate([self.hashes(self.raw, self.start, self.size), h]))
        else:
            self.table.put(h, np.arange(self.n, n, dtype=np.int32))
        ends = np.cumsum(size)
        own = raw[np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]))]
        self.start = np.concatenate([self.start, len(self.raw) - 8 + ends - size])
        self.size = np.concatenate([self.size, size])
        self.raw = padded(np.concatenate([self.raw[:-8], own]))
        self.n = n
