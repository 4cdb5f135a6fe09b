"""Suffix array by linear grouping: suffixes are first grouped by their Lyndon prefixes, then emitted in order.

Groups are processed from the highest down.  A suffix points to the nearest one before it that is in a lower group; of the suffixes
pointed at, those with more pointers move into higher groups right above the group they leave.  When all groups are done, each holds
the suffixes of one Lyndon prefix, and one pass that follows the pointers writes the order; ranks are never renamed.
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes in order; the last symbol must be smaller than all others and occur once."""
    n = len(text)
    slots = sorted(range(n), key=text.__getitem__)
    place, group, size, before = [0] * n, [0] * n, [0] * n, [-1] * n
    start = 0
    for k, i in enumerate(slots):
        if k and text[i] != text[slots[k - 1]]:
            start = k
        place[i], group[i] = k, start
        size[start] += 1
    end = n - 1
    while end >= 0:
        low = group[slots[end]]
        pointers: dict[int, int] = {}
        members = slots[low:end + 1] if low < end else (slots[low],)
        for i in sorted(members) if low < end else members:
            j = i - 1
            while j >= 0 and group[j] >= low:
                j = before[j]
            before[i] = j
            if j >= 0:
                pointers[j] = pointers.get(j, 0) + 1
        if len(pointers) == 1:
            (j, _), = pointers.items()
            _lift((j,), slots, place, group, size)
        elif pointers:
            alike: dict[tuple[int, int], list[int]] = {}
            for j, c in pointers.items():
                alike.setdefault((-c, group[j]), []).append(j)
            for key in sorted(alike):
                _lift(alike[key], slots, place, group, size)
        end = low - 1
    return _emitted(text, group, before)


def _lift(moved, slots: list[int], place: list[int], group: list[int], size: list[int]) -> None:
    """Moves suffixes of one group into a new group right above the rest."""
    old = group[moved[0]]
    top = old + size[old]
    if len(moved) == size[old]:
        return
    for j in moved:
        top -= 1
        i, k = slots[top], place[j]
        slots[top], slots[k], place[j], place[i] = j, i, top, k
    size[old] -= len(moved)
    size[top] = len(moved)
    for j in moved:
        group[j] = top


def _emitted(text: list[int], group: list[int], before: list[int]) -> list[int]:
    n = len(text)
    order, free, done = [-1] * n, list(range(n)), [False] * n
    order[0] = n - 1
    done[n - 1] = True
    for k in range(n):
        j = order[k] - 1
        while j >= 0 and not done[j]:
            done[j] = True
            order[free[group[j]]] = j
            free[group[j]] += 1
            j = before[j]
    return order
