"""Linear suffix sorting by grouping.

First, suffixes are put into groups by the longest Lyndon word that they begin with. Groups are taken from the highest to
the lowest: each member names the nearest suffix before it that stands in a lower group, and the suffixes so named move
behind their own group, those named by more members further up. Then the suffixes of each group are put in order: going up
the finished part of the array, each suffix releases those before it whose Lyndon word ends where it begins. Nothing is
renamed or sorted again.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of symbols (integers) in ascending order."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    # places 0..n: the text and an end that is less than all
    text = np.append(np.unique(symbols, return_inverse=True)[1] + 1, 0)
    order = np.argsort(text, kind="stable")
    rank_of = np.empty(n + 1, np.int64)
    rank_of[order] = np.arange(n + 1)
    firsts = np.searchsorted(text[order], text, "left")
    sorted_, place, group = order.tolist(), rank_of.tolist(), firsts.tolist()
    before = _grouped(sorted_, place, group)
    return np.array(_emitted(sorted_, group, before)[1:], np.int64)


def _grouped(order: list[int], place: list[int], group: list[int]) -> list[int]:
    """Refines order and group (a suffix's group is the first place of it) into Lyndon groups; returns the nearest suffix
    before each that stands in a lower group, or -1."""
    n = len(order)
    before = [-1] * n
    named = [0] * n
    size = [0] * n
    for g in group:
        size[g] += 1
    top = n - 1
    while top >= 0:
        low = group[order[top]]
        members = order[low : top + 1]
        if len(members) > 1:
            members.sort()
        touched = []
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= low:
                j = before[j]
            before[i] = j
            if j >= 0:
                if not named[j]:
                    touched.append(j)
                named[j] += 1
        if touched:
            if len(touched) == 1:
                j = touched[0]
                _move(j, order, place, group, size)
                named[j] = 0
            else:
                by: dict[int, list[int]] = {}
                for j in touched:
                    by.setdefault(named[j], []).append(j)
                    named[j] = 0
                for times in sorted(by, reverse=True):
                    parts: dict[int, list[int]] = {}
                    for j in by[times]:
                        parts.setdefault(group[j], []).append(j)
                    for g, moved in parts.items():
                        _move_all(g, moved, order, place, group, size)
        top = low - 1
    return before


def _move(j: int, order: list[int], place: list[int], group: list[int], size: list[int]) -> None:
    g = group[j]
    if size[g] == 1:
        return
    end = g + size[g] - 1
    other, at = order[end], place[j]
    order[at], place[other] = other, at
    order[end], place[j] = j, end
    size[g] -= 1
    group[j], size[end] = end, 1


def _move_all(g: int, moved: list[int], order: list[int], place: list[int], group: list[int], size: list[int]) -> None:
    if len(moved) == size[g]:
        return
    end = g + size[g] - 1
    for j in moved:
        other, at = order[end], place[j]
        order[at], place[other] = other, at
        order[end], place[j] = j, end
        end -= 1
    size[g] -= len(moved)
    size[end + 1] = len(moved)
    for j in moved:
        group[j] = end + 1


def _emitted(order: list[int], group: list[int], before: list[int]) -> list[int]:
    n = len(order)
    out = [-1] * n
    free = list(range(n))  # next place of each group
    # where the Lyndon word of each suffix ends: the first later suffix in a lower group with a nearest one no later
    ends = _ends(group, before)
    out[0] = n - 1
    for k in range(n):
        s = out[k]
        j = s - 1
        while j >= 0 and ends[j] == s:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            j = before[j]
    return out


def _ends(group: list[int], before: list[int]) -> list[int]:
    """The next suffix that is less than each: a stack of suffixes whose words go on."""
    n = len(group)
    ends = [n] * n
    stack: list[int] = []
    for i in range(n):
        least = before[i]
        while stack and stack[-1] > least:
            ends[stack.pop()] = i
        stack.append(i)
    return ends
