"""Suffix arrays by linear grouping: suffixes are grouped by their longest Lyndon prefix, then each group's order is read off.

First phase. Suffixes are grouped by their first symbol, and groups taken in descending order. A member's previous smaller pointer leads to the
nearest suffix before it that lies in a lower group; that suffix's prefix is extended by the group's prefix, as often as members point
to it, so those that were pointed to most often come last of their old group. When all groups are through, each holds the suffixes of one
Lyndon prefix. Second phase. From the smallest suffix on, the one before each placed suffix takes the next free place of its group,
and so does all that its pointers lead to and that has no place yet. Nothing is sorted by content and nothing renamed; both phases visit
each pointer a bounded number of times."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of symbols (whole numbers >= 1), in ascending order; the end of the text is smaller than any symbol."""
    n = len(symbols) + 1
    text = np.append(symbols, 0).astype(np.int64)
    order = np.argsort(text, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], np.diff(text[order]) != 0]))
    sizes = np.diff(np.append(heads, n))
    row, place, group = order.tolist(), np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    group[order] = np.repeat(heads, sizes)  # a group is named by its first row
    place, group = place.tolist(), group.tolist()
    last = [0] * n  # the last row of the group of that name
    for h, s in zip(heads.tolist(), sizes.tolist(), strict=True):
        last[h] = h + s - 1
    before = _previous_smaller(row, place, group, last)
    return np.array(_emit(before, group, n)[1:], dtype=np.int64)


def _previous_smaller(row: list, place: list, group: list, last: list) -> list:
    """The first phase: refines group in place and returns each suffix's pointer (-1: none)."""
    n = len(row)
    before = [-1] * n
    end = n - 1
    while end >= 0:
        g = group[row[end]]
        if g == end:  # alone
            i = row[end]
            end -= 1
            j = i - 1
            while j >= 0 and group[j] > g:
                j = before[j]
            before[i] = j
            if j >= 0:
                gj = group[j]
                e = last[gj]
                if gj != e:
                    p = place[j]
                    if p != e:
                        q = row[e]
                        row[p] = q
                        place[q] = p
                        row[e] = j
                        place[j] = e
                    last[gj] = e - 1
                    group[j] = last[e] = e
            continue
        pointed: dict[int, int] = {}
        for i in sorted(row[g : end + 1]):
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = before[j]
            before[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        end = g - 1
        by_count: dict[int, list[int]] = {}
        for j, c in pointed.items():
            by_count.setdefault(c, []).append(j)
        for c in sorted(by_count, reverse=True):
            moved: dict[int, int] = {}
            for j in by_count[c]:
                gj = group[j]
                e = last[gj]
                p = place[j]
                if p != e:
                    q = row[e]
                    row[p] = q
                    place[q] = p
                    row[e] = j
                    place[j] = e
                last[gj] = e - 1
                moved[gj] = moved.get(gj, 0) + 1
            for gj, m in moved.items():
                s = last[gj] + 1
                last[s] = s + m - 1  # if the whole group moved, s is its own name
                if s != gj:
                    for j in row[s : s + m]:
                        group[j] = s
    return before


def _emit(before: list, group: list, n: int) -> list:
    """The second phase: all suffixes in order, the empty one first."""
    free, out, placed = list(range(n)), [0] * n, [False] * n
    out[0] = n - 1
    placed[n - 1] = True
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            s = free[g]
            out[s] = j
            free[g] = s + 1
            placed[j] = True
            j = before[j]
    return out
