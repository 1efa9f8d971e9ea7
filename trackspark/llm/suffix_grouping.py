"""Suffix arrays of many short texts at once, by grouping.

Phase one: suffixes of one Lyndon prefix form a group; at first a suffix's group is its first symbol's. Groups are taken in
descending order. Each member of a group points to its previous smaller suffix, and the suffixes pointed to, by how many
members follow them, part from their groups to the groups' upper ends: their prefix now goes on with the group's string.
Phase two: in ascending order each suffix places, along the pointers, the suffixes whose Lyndon prefix ends where it
begins, at the next free place of their group. No group is ever renamed or sorted again, and both phases are linear.

All texts advance together, one group of each in a round, so the steps are numpy operations on many texts.
"""

from __future__ import annotations

import numpy as np

#: Longer texts are emitted one by one.
_LONG = 4096


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each start and size, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(starts, sizes)


def lyndon_groups(symbols: np.ndarray, base: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place: where its suffix's group begins among the places of its text, and its previous smaller suffix (or one before the text)."""
    total = len(symbols)
    text = np.repeat(np.arange(len(base)), length)
    order = np.lexsort((symbols, text))  # by first symbol, text by text
    new = np.ones(total, bool)
    new[1:] = (symbols[order][1:] != symbols[order][:-1]) | (text[order][1:] != text[order][:-1])
    starts = np.flatnonzero(new)
    group = np.empty(total, np.int64)
    size = np.zeros(total, np.int64)
    size[starts] = np.diff(np.append(starts, total))
    group[order] = np.repeat(starts, size[starts])
    at = np.empty(total, np.int64)
    at[order] = np.arange(total)
    before = np.arange(-1, total - 1)
    moving = np.zeros(total, bool)
    end = base + length
    live = np.flatnonzero(length > 1)
    while len(live):
        low = group[order[end[live] - 1]]
        sizes = end[live] - low
        members = order[_ranges(low, sizes)]
        first, own = np.repeat(base[live], sizes), np.repeat(low, sizes)
        p = before[members]
        open_ = np.flatnonzero((p >= first) & (group[p] >= own))
        while len(open_):  # past larger suffixes, and past members along pointers that move on as well
            p[open_] = before[p[open_]]
            before[members[open_]] = p[open_]
            q = p[open_]
            open_ = open_[(q >= first[open_]) & (group[q] >= own[open_])]
        before[members] = p
        parents, times = np.unique(p[p >= first], return_counts=True)
        for k in np.unique(times)[::-1] if len(times) and times.max() > 1 else (1,):
            part = parents[times == k]
            if len(part) == 0:
                continue
            part = part[np.argsort(group[part], kind="stable")]
            olds, counts = np.unique(group[part], return_counts=True)
            fresh = olds + size[olds] - counts
            some = fresh > olds  # else the whole group moves: it stays as it is
            olds_, counts_, fresh_ = olds[some], counts[some], fresh[some]
            if len(olds_):
                part = part[np.repeat(some, counts)]
                moving[part] = True
                slots = _ranges(fresh_, counts_)
                target = np.repeat(fresh_, counts_)
                there = order[slots]
                out_slots = slots[~moving[there]]
                out = order[out_slots]
                outside = at[part] < target
                into = part[outside]
                holes = at[into]
                order[holes], order[out_slots] = out, into
                at[out], at[into] = holes, out_slots
                group[part] = target
                size[olds_] -= counts_
                size[fresh_] = counts_
                moving[part] = False
        end[live] = low
        live = live[end[live] > base[live] + 1]
    return group, before


def suffix_arrays(symbols: np.ndarray, base: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places of the suffixes in order, text by text. Each text ends with a symbol that is smaller than all its others."""
    group, before = lyndon_groups(symbols, base.astype(np.int64), length.astype(np.int64))
    total = len(symbols)
    out = np.empty(total, np.int64)
    free = np.arange(total)
    placed = np.zeros(total, bool)
    last = base + length - 1
    out[base], placed[last] = last, True
    for t in np.flatnonzero(length > _LONG):
        _emit(out, group, before, int(base[t]), int(length[t]))
    some = np.flatnonzero(length <= _LONG)
    some = some[np.argsort(-length[some], kind="stable")]
    n, b = length[some], base[some]
    count = np.searchsorted(-n, -np.arange(n[0] if len(n) else 0), "left")  # texts that are longer than i
    for i, live in enumerate(count):
        s = out[b[:live] + i] - 1
        low = b[:live]
        keep = s >= low
        keep &= ~placed[s]
        s, low = s[keep], low[keep]
        while len(s):
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            placed[s] = True
            s = before[s]
            keep = (s >= low) & ~placed[s]
            s, low = s[keep], low[keep]
    return out


def _emit(out: np.ndarray, group: np.ndarray, before: np.ndarray, base: int, n: int) -> None:
    """Phase two of one long text."""
    groups, back = (group[base : base + n] - base).tolist(), (before[base : base + n] - base).tolist()
    free, placed, order = list(range(n)), [False] * n, [0] * n
    order[0], placed[n - 1] = n - 1, True
    for i in range(n):
        s = order[i] - 1
        while s >= 0 and not placed[s]:
            g = groups[s]
            order[free[g]] = s
            free[g] += 1
            placed[s] = True
            s = back[s]
    out[base : base + n] = np.array(order) + base
