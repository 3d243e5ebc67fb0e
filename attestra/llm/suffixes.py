"""Suffix sorting by linear grouping.

Phase 1 groups suffixes by their longest Lyndon prefix: groups are processed from the greatest
down; each member points to the previous suffix of a smaller group, and suffixes pointed to by the
same number of members move together into a new group right above their old one.  Phase 2 walks
the ranks upwards and places each suffix's predecessors, along the same pointers, at the front of
their groups.  No renaming, no recursion.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``text`` (non-negative integers); a shorter prefix comes first."""
    n = len(text) + 1
    if n == 1:
        return np.empty(0, np.int64)
    padded = np.zeros(n, np.int64)
    padded[:-1] = np.asarray(text, np.int64) + 1  # 0 ends the text and is the least
    order_np = np.argsort(padded, kind="stable")
    ranked = padded[order_np]
    heads = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    sizes_np = np.diff(np.r_[heads, n])
    group_np = np.empty(n, np.int64)
    group_np[order_np] = np.repeat(heads, sizes_np)
    spot_np = np.empty(n, np.int64)
    spot_np[order_np] = np.arange(n)
    size_np = np.zeros(n, np.int64)
    size_np[heads] = sizes_np

    # A group is a run of ``order``; it is named by where the run starts.
    order, group, spot, size = order_np.tolist(), group_np.tolist(), spot_np.tolist(), size_np.tolist()
    previous = [-1] * n
    end = n
    while end > 0:
        g = group[order[end - 1]]
        members = order[g:end]
        if len(members) > 1:
            members.sort()
        times: dict[int, int] = {}
        for m in members:
            j = m - 1
            while j >= 0 and group[j] >= g:
                j = previous[j]
            previous[m] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        end = g
        if not times:
            continue
        if len(times) == 1:
            ((j, _),) = times.items()
            batches = [[j]]
        else:
            by_times: dict[int, dict[int, list[int]]] = {}
            for j, k in times.items():
                by_times.setdefault(k, {}).setdefault(group[j], []).append(j)
            batches = [b for k in sorted(by_times, reverse=True) for b in by_times[k].values()]
        for batch in batches:
            old = group[batch[0]]
            held = size[old]
            moved = len(batch)
            if moved == held:
                continue
            new = old + held - moved
            at = old + held - 1
            for j in batch:  # to the upper end of the old group's run
                other = order[at]
                if other != j:
                    p = spot[j]
                    order[p] = other
                    spot[other] = p
                    order[at] = j
                    spot[j] = at
                group[j] = new
                at -= 1
            size[old] = held - moved
            size[new] = moved

    front = list(range(n))  # next free rank of the group that starts there
    ranks = [-1] * n
    placed = [False] * n
    ranks[0] = n - 1
    placed[n - 1] = True
    for i in range(n):
        j = ranks[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            p = front[g]
            ranks[p] = j
            front[g] = p + 1
            placed[j] = True
            j = previous[j]
    return np.array(ranks[1:], np.int64)
