"""Suffix arrays by linear grouping construction.

Baier, "Linear-time Suffix Sorting: A New Approach for Suffix Array
Construction" (2016).  Suffixes are first grouped by their longest Lyndon
prefix.  Groups are visited from the greatest to the least; each suffix of a
group points to the nearest suffix before it whose group is smaller, and that
one's prefix grows: it moves into a new group right above its old one.  When
all groups have been visited, the order inside each group follows in one scan
from the least suffix on, without a recursion on renamed texts.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of all suffixes in order; the last symbol must be the least one and occur once.

    Symbols are not negative.  All steps are linear in the length and the
    greatest symbol: suffixes are dealt by their first symbol by counting, and
    nothing is sorted by comparison.
    """
    n = len(text)
    begin = [0] * (max(text) + 2)
    for c in text:
        begin[c + 1] += 1
    size = [0] * n  # by group start
    at = 0
    for c in range(1, len(begin)):
        if begin[c]:
            size[at] = begin[c]
            at += begin[c]
        begin[c] = at
    start = [begin[c] for c in text]  # of a suffix: where its group begins
    order, place = [0] * n, [0] * n
    for i, c in enumerate(text):
        place[i] = k = begin[c]
        order[k] = i
        begin[c] = k + 1
    smaller = [-1] * n  # of a suffix: the nearest one before it in a smaller group
    end = n
    while end > 0:
        top = start[order[end - 1]]
        if end - top == 1:
            i = order[top]
            j = i - 1
            while j >= 0 and start[j] >= top:
                j = smaller[j]
            smaller[i] = j
            if j >= 0 and size[start[j]] > 1:
                old = start[j]
                size[old] -= 1
                new = old + size[old]
                k, other = place[j], order[new]
                order[k], order[new] = other, j
                place[other], place[j] = k, new
                start[j] = new
                size[new] = 1
            end = top
            continue
        group = order[top:end]
        same: dict[int, int] = {}  # the nearest one before a suffix is of its own group
        for i in group:
            j = i - 1
            while j >= 0 and start[j] > top:
                j = smaller[j]
            if j >= 0 and start[j] == top:
                same[i] = j
            else:
                smaller[i] = j
        for i in same:  # chains of them end at one that knows its smaller one; each link is followed once
            chain = []
            while i in same and same[i] >= 0:
                chain.append(i)
                after, same[i] = same[i], -1
                i = after
            for x in chain:
                smaller[x] = smaller[i]
        hits: dict[int, int] = {}
        for i in group:
            j = smaller[i]
            if j >= 0:
                hits[j] = hits.get(j, 0) + 1
        levels: dict[int, list[int]] = {}
        for j, times in hits.items():
            levels.setdefault(times, []).append(j)
        for times in range(max(levels, default=0), 0, -1):
            moved = levels.get(times, ())
            for j in moved:
                old = start[j]
                size[old] -= 1
                new = old + size[old]
                k, other = place[j], order[new]
                order[k], order[new] = other, j
                place[other], place[j] = k, new
            for j in moved:
                # All that left one group stand together behind what is left of it.
                start[j] = start[j] + size[start[j]] if size[start[j]] else start[j]
            for j in moved:
                size[start[j]] += 1
        end = top
    out = [0] * n
    done = [False] * n
    out[0] = n - 1
    done[n - 1] = True
    free = list(range(n))  # by group start: its next free place
    for r in range(n):
        j = out[r] - 1
        while j >= 0 and not done[j]:
            g = start[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = True
            j = smaller[j]
    return out
