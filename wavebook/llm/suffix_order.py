"""Suffix sorting by linear grouping.

Suffixes are first grouped by their Lyndon prefix, the longest prefix that is
smaller than all its proper suffixes: groups are taken from the greatest down, and
every suffix in front of a member of the group, found by its pointer to the previous
smaller group, moves into a group of its own right above its old one. Then the
order is emitted in one pass: whenever the place of a suffix is known, the suffixes
whose Lyndon prefix ends there take the next place of their groups. Nothing is
renamed and there is no recursion.
"""

from __future__ import annotations

import numpy as np


def lyndon_groups(text: list[int]) -> tuple[list[int], list[int]]:
    """(group, previous): for every suffix the first place of its group, and the nearest
    earlier suffix of a smaller group, or -1.

    The text must end with a symbol smaller than all others.
    """
    n = len(text)
    order = np.argsort(np.array(text), kind="stable").tolist()
    place = [0] * n
    group = [0] * n
    size = [0] * n
    start = 0
    for at, i in enumerate(order):
        if text[i] != text[order[start]]:
            start = at
        place[i] = at
        group[i] = start
        size[start] += 1
    previous = [-1] * n
    end = n
    while end > 0:
        start = group[order[end - 1]]
        times: dict[int, int] = {}
        for i in sorted(order[start:end]):
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        end = start
        # A suffix in front of several members is extended as often, so it moves as often.
        moving = list(times)
        turn = 1
        while moving:
            taken: dict[int, int] = {}
            for p in moving:
                g = group[p]
                k = taken.get(g, 0) + 1
                taken[g] = k
                last, here = g + size[g] - k, place[p]
                other = order[last]
                order[last], order[here] = p, other
                place[p], place[other] = last, here
            for g, k in taken.items():
                rest = size[g] - k
                if rest:
                    above = g + rest
                    size[g], size[above] = rest, k
                    for at in range(above, above + k):
                        group[order[at]] = above
            turn += 1
            moving = [p for p in moving if times[p] >= turn]
    return group, previous


def suffix_order(text: list[int]) -> list[int]:
    """Starts of all suffixes of a text in ascending order.

    The text must end with a symbol smaller than all others.
    """
    group, previous = lyndon_groups(text)
    n = len(text)
    order = [0] * n
    order[0] = n - 1
    vacant = list(range(n))
    placed = [False] * n
    placed[n - 1] = True
    for at in range(n):
        i = order[at] - 1
        while i >= 0 and not placed[i]:
            g = group[i]
            order[vacant[g]] = i
            vacant[g] += 1
            placed[i] = True
            i = previous[i]
    return order
