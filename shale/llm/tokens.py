"""Word hashes of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def word_hashes(texts: list[str], fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word, its length in bytes, and each text's number of words.

    Words are runs of bytes other than the six ASCII blanks, A-Z folded. A word's hash is its polynomial modulo 2 ** 64,
    taken from one running sum over all texts, then mixed: equal words have equal hashes wherever they stand.
    """
    raw = np.frombuffer("\n".join(texts).encode("utf-8", "replace"), dtype=np.uint8)
    if fold:
        raw = FOLD[raw]
    size = np.fromiter((len(t.encode("utf-8", "replace")) for t in texts), dtype=np.int64, count=len(texts))
    edge = np.diff(np.r_[True, BLANK[raw], True].astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    total = np.r_[np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(len(raw), BASE), dtype=np.uint64)]
    h = mixed((total[end] - total[start]) * _powers(len(raw) + 1, INVERSE)[start])
    at = np.cumsum(size + 1)  # texts end here, with the line feed between them
    return h, end - start, np.diff(np.searchsorted(start, at), prepend=0)


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words within a text, and each text's number of them; a shorter text is one run."""
    n = len(words)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        h[: max(n - k, 0)] += words[k:] * np.uint64((2 * k + 1) * 0xD6E8FEB86659FD93 % 2**64)
    ends = np.cumsum(counts)
    left = np.repeat(ends, counts) - np.arange(n)  # words from here to the end of the text
    keep = left >= size
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        first = (ends - counts)[short]
        for f, c in zip(first.tolist(), counts[short].tolist(), strict=True):
            h[f] = sum((int(words[f + k]) * ((2 * k + 1) * 0xD6E8FEB86659FD93 % 2**64) for k in range(c)), 7 * c) % 2**64
        keep[first] = True
    return mixed(h[keep]), np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
