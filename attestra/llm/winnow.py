"""Anchors: a sample of grams, chosen by content, of which every window of a given length holds one.

For windows of ``length`` items the grams of ``gram`` items inside a window are hashed and the one
with the least hash (the leftmost on ties) is the window's anchor.  Equal windows have equal
anchors at equal places, so two texts share a window only if they share an anchor: joining the few
anchors (two in every ``length - gram + 2`` items) finds every shared window.
"""

from __future__ import annotations

import numpy as np

#: Low bits that hold a position while minima are sought; the same for every block, so ties agree.
_POSITION_BITS = np.uint64(28)
_POSITION = np.uint64((1 << 28) - 1)


def least_in_windows(grams: np.ndarray, width: int) -> np.ndarray:
    """Position of the least of each ``width`` consecutive hashes, by doubling."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while size * 2 <= width:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    best = np.minimum(best[:n], best[width - size : width - size + n])
    return (best & _POSITION).astype(np.int64)


def contexts(grams: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows with one anchor: ``row, first start, last start, anchor position``.

    ``grams[i]`` hashes the gram at item ``i`` of a block; ``offsets`` are the rows' first items.
    Windows that leave their row are left out.
    """
    at = least_in_windows(grams, length - gram + 1)
    counts = np.diff(offsets) - length + 1
    rows = np.flatnonzero(counts > 0)
    n = counts[rows]
    if not len(rows):
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty
    begin = np.cumsum(n) - n
    starts = np.repeat(offsets[rows] - begin, n) + np.arange(n.sum())
    anchors = at[starts]
    cut = np.zeros(len(starts), bool)
    cut[begin] = True
    cut[1:] |= anchors[1:] != anchors[:-1]
    first = np.flatnonzero(cut)
    last = np.r_[first[1:], len(starts)] - 1
    return np.repeat(rows, n)[first], starts[first], starts[last], anchors[first]


def ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the closed ranges, and the range each comes from."""
    size = last - first + 1
    before = np.cumsum(size) - size
    return np.repeat(first - before, size) + np.arange(size.sum()), np.repeat(np.arange(len(first)), size)
