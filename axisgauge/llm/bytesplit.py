"""Splitting and hashing of many texts at once, as numpy work on the bytes of an Arrow batch."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes worked on at once; longer texts are cut at white space, so that memory stays bounded.
BLOCK = 1 << 19
SPACE_BYTE = np.zeros(256, bool)
SPACE_BYTE[[9, 10, 11, 12, 13, 32]] = True
LOWER_BYTE = np.arange(256, dtype=np.uint8)
LOWER_BYTE[65:91] += 32
_BASE = 0x9E3779B97F4A7C55 | 1
_reach = BLOCK + 1


@functools.lru_cache(1)  # one table: it stays in a worker between tasks
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's first n powers and their inverses, modulo 2 to the 64."""
    up = np.full(n, _BASE, np.uint64)
    down = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def release() -> None:
    """Gives memory that a task no longer uses back to the system, since workers live on after their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL(None).malloc_trim(0)


def giving_back(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's work, after whose end, when nothing refers to its last batch any more, memory goes back to the system."""

    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        release()

    return worked


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Tables only grow, by steps of `BLOCK`, and the last one serves all shorter spans."""
    global _reach
    _reach = max(_reach, -(-int(n) // BLOCK) * BLOCK + 1)
    up, down = _powers(_reach)
    return up[:n], down[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all bits (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def packed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in a row and each text's bounds; null counts as empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    n = len(texts)
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    bounds = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def blocks(data: np.ndarray, bounds: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """(first text, bytes, bounds, goes on): runs of texts of at most `most` bytes. A longer text comes in parts, cut at
    white space where there is any within reach; goes on says that the block's last text has more parts."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1, i + 1)
        if bounds[j] - bounds[i] <= most:
            yield i, data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], False
        else:
            at, end = bounds[i], bounds[j]
            while at < end:
                to = min(at + most, end)
                if to < end:
                    gaps = np.flatnonzero(SPACE_BYTE[data[at:to]])
                    while not len(gaps) and to < end:
                        to = min(to + most, end)
                        gaps = np.flatnonzero(SPACE_BYTE[data[at:to]])
                    to = at + gaps[-1] + 1 if len(gaps) and to < end else to
                yield i, data[at:to], np.array([0, to - at]), to < end
                at = to
        i = j


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; no run crosses a text's end."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(len(inside), bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[bounds[:-1][bounds[:-1] < len(inside)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(inside), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from one running sum of a polynomial."""
    up, down = powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def owners(starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of the (rising) starts each text has."""
    return np.diff(np.searchsorted(starts, bounds))


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, ASCII letters lower-cased, and the number of words of each text."""
    hashes, counts, i, n = [np.zeros(0, np.uint64)], np.zeros(len(bounds) - 1, np.int64), 0, len(bounds) - 1
    for i, part, b, _ in blocks(data, bounds):
        starts, ends = runs(~SPACE_BYTE[part], b)
        hashes.append(span_hashes(LOWER_BYTE[part], starts, ends))
        counts[i : i + len(b) - 1] += owners(starts, b)
    return np.concatenate(hashes), counts


def shingle_hashes(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each text's runs of `width` words, repeated ones included, and their number; a text with fewer
    words has its whole sequence as one, and a text without words none."""
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    to = np.cumsum(sizes)
    first = np.cumsum(counts) - counts
    at = np.repeat(first - (to - sizes), sizes) + np.arange(int(sizes.sum()))
    length = np.repeat(np.minimum(counts, width), sizes)
    out = np.zeros(len(at), np.uint64)
    padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
    for k in range(width):
        step = (out ^ padded[at + k]) * np.uint64(0xD6E8FEB86659FD93)
        out = np.where(length > k, step ^ (step >> np.uint64(29)), out)
    return mixed(out + length.astype(np.uint64)), sizes
