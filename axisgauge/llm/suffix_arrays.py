"""Suffix arrays of one shard's bytes: Larsson-Sadakane refinement and Kasai's common prefixes, in numpy."""

from __future__ import annotations

import numpy as np


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one big-endian number; zeros follow the end."""
    held = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), ">u8", held.data, 0, (1,)).astype(np.uint64)


def suffix_order(data: np.ndarray) -> np.ndarray:
    """Positions in the order of the suffixes that begin there; a position's group number is its place in that order.

    The first groups come from eight bytes. Each round doubles the length that the order respects, sorting only the
    groups that still have several members by the group number that far ahead, until every group has one.
    """
    n = len(data)
    first = words_at(data)
    order = np.argsort(first)
    first = first[order]
    new = np.concatenate([[True], first[1:] != first[:-1]])
    rank = np.empty(n + 9, np.int64)
    rank[:n][order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[n:] = -1 - np.arange(9)  # beyond the end: before everything, and no two alike
    several = np.flatnonzero(~new | ~np.append(new[1:], True))  # places in groups of two or more
    h = 8
    while len(several):
        at = order[several]
        key = rank[at] * np.int64(n + 10) + (rank[np.minimum(at + h, n + 8)] + 9)
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[several] = at
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[at] = several[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        several = several[~new | ~np.append(new[1:], True)]
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int, stride: int = 32) -> np.ndarray:
    """For each place of the order the bytes shared with the place before, `most` at most, by Kasai's rule: one
    position's common prefix is at least that of the position before it less one. Every stride-th position is compared
    from the start, the others from that bound on, all strides at once."""
    n = len(data)
    words = np.concatenate([words_at(data), np.zeros(1, np.uint64)])
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[:1]] = -1
    shared = np.zeros(n, np.int64)
    for d in range(stride):
        at = np.arange(d, n, stride)
        other = before[at]
        length = np.maximum(shared[at - 1] - 1, 0) if d else np.zeros(len(at), np.int64)
        active = np.flatnonzero(other >= 0)
        while len(active):
            x, y = at[active] + length[active], other[active] + length[active]
            room = n - np.maximum(x, y)
            differ = words[np.minimum(x, n)] ^ words[np.minimum(y, n)]
            same = np.full(len(active), 8, np.int64)
            some = differ > 0
            # the number of leading zero bytes of the difference
            same[some] = 7 - np.floor(np.log2(differ[some].astype(np.float64) * (1 + 2**-52))).astype(np.int64).clip(0, 63) // 8
            same = np.minimum(same, np.maximum(room, 0))
            length[active] += same
            active = active[(same == 8) & (length[active] < most)]
        length[other < 0] = 0
        shared[at] = np.minimum(length, most)
    return shared[order]


def repeated_starts(data: np.ndarray, starts: np.ndarray, weight: np.ndarray, window: int) -> np.ndarray:
    """Which of the (distinct) starts begin a `window`-byte string that also begins at another start; weight has the
    number of places that each start stands for."""
    if not len(data):
        return np.zeros(len(starts), bool)
    order = suffix_order(data)
    shared = common_prefixes(data, order, window)
    group = np.cumsum(shared < window)  # runs of suffixes that agree on a window
    of = np.empty(len(data), np.int64)
    of[order] = group
    times = np.bincount(of[starts], weight, minlength=int(group[-1]) + 1)
    return times[of[starts]] > 1
