"""Binary trie self-join: links between fingerprints that differ in few bits, as connected groups.

A sorted run of bit strings is a binary trie: a node is a range of places, its children the ranges on either side of
the place where the next bit turns to 1. The join walks pairs of nodes together, adds up the bits in which their paths
differ, and drops a pair once they are more than the budget. Pairs of nodes whose members are all known to be in one
group are dropped too: only groups matter, and this keeps dense groups from costing the square of their size. Every
other pair of members within the budget is compared by its full fingerprint.

Pairs are walked depth first in chunks, so memory is bounded by the number of members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Pairs of nodes that are walked at a time; members of a node up to which all its pairs are compared at once.
CHUNK, LEAF = 1 << 14, 8
#: Links that wait to be merged, at most: this part (a power of two) of all members.
MERGE = 6
HOPS = (1, 2, 3, 5, 8)


def groups(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The least member of each place's group, given links a[i] - b[i] and earlier labels."""
    label = np.arange(n) if label is None else label.copy()
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        while not (label == label[label]).all():
            label = label[label]
        if (label == before).all():
            return label


def _middle(bits: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """First place of lo..hi whose bit at depth is 1; halves where all bits are used."""
    spent = depth >= 64
    shift = np.uint64(63) - np.minimum(depth, 63).astype(np.uint64)
    a, b = lo.copy(), hi.copy()
    while (open_ := a < b).any():
        m = (a + b) // 2
        one = ((bits[np.minimum(m, len(bits) - 1)] >> shift) & np.uint64(1)) == 1
        b = np.where(open_ & one, m, b)
        a = np.where(open_ & ~one, m + 1, a)
    return np.where(spent, (lo + hi) // 2, a)


def _members(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a member of a range with one of its partner; of a range with itself each pair once."""
    n, width = (a1 - a0) * (b1 - b0), b1 - b0
    of = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    i, j = a0[of] + at // width[of], b0[of] + at % width[of]
    once = (a0[of] != b0[of]) | (i < j)
    return i[once], j[once]


def _walk(group: np.ndarray, depth: np.ndarray, split: np.ndarray, bits: np.ndarray, budget: int, known: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places whose bits differ in at most budget; known(a0, a1, b0, b1): which pairs of ranges need no look."""
    n = len(group)
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
    end = np.r_[start[1:], n].astype(np.int64)
    keep = end - start > 1
    start, end = start[keep], end[keep]
    d, two = depth[start], split[start]
    prefix = lambda i, d: bits[i] >> (np.uint64(64) - d.astype(np.uint64))
    # A split group's sides lie one after the other: cut where the prefix changes.
    cut = end.copy()
    if two.any():
        changes = np.flatnonzero(np.r_[False, (group[1:] == group[:-1]) & (prefix(np.arange(1, n), depth[1:]) != prefix(np.arange(n - 1), depth[1:]))])
        at = np.searchsorted(changes, start)
        first = np.where(at < len(changes), changes[np.minimum(at, max(len(changes) - 1, 0))] if len(changes) else end, end)
        cut = np.where(two, np.minimum(first, end), end)
    lone = two & (cut == end)
    start, end, cut, d, two = (x[~lone] for x in (start, end, cut, d, two))
    err = np.where(two, np.bitwise_count(prefix(start, d) ^ prefix(end - 1, d)), 0).astype(np.int64)
    a0, a1 = start, np.where(two, cut, end)
    b0, b1 = np.where(two, cut, start), end
    stack = [(a0, a1, b0, b1, d.astype(np.int64), err)]
    while stack:
        a0, a1, b0, b1, d, err = stack.pop()
        if len(a0) > CHUNK:
            stack.append(tuple(x[CHUNK:] for x in (a0, a1, b0, b1, d, err)))
            a0, a1, b0, b1, d, err = (x[:CHUNK] for x in (a0, a1, b0, b1, d, err))
        open_ = ~known(a0, a1, b0, b1)
        a0, a1, b0, b1, d, err = (x[open_] for x in (a0, a1, b0, b1, d, err))
        leaf = (a1 - a0 <= LEAF) & (b1 - b0 <= LEAF)
        if leaf.any():
            i, j = _members(a0[leaf], a1[leaf], b0[leaf], b1[leaf])
            near = np.bitwise_count(bits[i] ^ bits[j]) <= budget
            yield i[near], j[near]
            a0, a1, b0, b1, d, err = (x[~leaf] for x in (a0, a1, b0, b1, d, err))
        if not len(a0):
            continue
        own = (a0 == b0) & (a1 == b1)
        am, bm = _middle(bits, a0, a1, d), _middle(bits, b0, b1, d)
        more = np.where(d < 64, 1, 0)
        parts = [(a0, am, b0, bm, d + 1, err), (am, a1, bm, b1, d + 1, err), (a0, am, bm, b1, d + 1, err + more)]
        cross = ~own
        parts.append(tuple(x[cross] for x in (am, a1, b0, bm, d + 1, err + more)))
        a0, a1, b0, b1, d, err = (np.concatenate(x) for x in zip(*parts, strict=True))
        own = (a0 == b0) & (a1 == b1)
        keep = (a1 > a0) & (b1 > b0) & (err <= budget) & ~(own & (a1 - a0 < 2))
        if keep.any():
            stack.append(tuple(x[keep] for x in (a0, a1, b0, b1, d, err)))


def _changes(label: np.ndarray) -> np.ndarray:
    """So many changes of label up to each place: a range with none has one label."""
    return np.cumsum(np.r_[0, label[1:] != label[:-1]]) if len(label) else label


def self_join(group: np.ndarray, depth: np.ndarray, split: np.ndarray, bits: np.ndarray, prints: np.ndarray, budget: int, most: int) -> np.ndarray:
    """For each place, the least place of its group of links.

    group: ascending; only members of one are compared. depth: bits that a group's members share (or, where split, that
    its two sides share each). split: only members of different prefixes of that length are compared. bits: ascending
    within a group, used from the left; two members meet only if these differ in at most budget bits. prints: (n, w)
    full fingerprints; a link is a difference of at most `most` bits.
    """
    n = len(group)
    distance = lambda i, j: np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1)
    label = np.arange(n)
    for hop in HOPS:  # neighbours first: dense groups close quickly
        i = np.flatnonzero(group[hop:] == group[:-hop]) if n > hop else np.zeros(0, np.int64)
        i = i[label[i] != label[i + hop]]
        i = i[distance(i, i + hop) <= most]
        label = groups(n, i, i + hop, label)
    change = _changes(label)

    def known(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
        return (change[a1 - 1] == change[a0]) & (change[b1 - 1] == change[b0]) & (label[a0] == label[b0])

    links: list[tuple[np.ndarray, np.ndarray]] = []
    for i, j in _walk(group, depth, split, bits, budget, known):
        new = label[i] != label[j]
        i, j = i[new], j[new]
        near = distance(i, j) <= most
        links.append((i[near], j[near]))
        if sum(len(x) for x, _ in links) > n >> MERGE:  # merging looks at all members, so some links are gathered for it
            label = groups(n, *(np.concatenate(x) for x in zip(*links, strict=True)), label)
            change = _changes(label)
            links.clear()
    return groups(n, *(np.concatenate(x) for x in zip(*links, strict=True)), label) if links else label
