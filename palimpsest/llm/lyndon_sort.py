"""Suffix sorting by linear grouping construction: Lyndon-prefix groups in descending order, no recursive renaming.

Suffixes start grouped by their first symbol. Groups are taken from the highest to the lowest; when a group's turn
comes, its context (the Lyndon prefix that all its suffixes share) is final. Each of its suffixes points to its
previous smaller suffix, the last one before it that lies in a lower group; a suffix that gets c such pointers has c
copies of the context appended to its own, and so leaves its group for a new one just above it, the more copies the
higher. Afterwards the groups are in final order, and one ascending sweep emits the order inside each: when a suffix
has been emitted, every suffix whose Lyndon prefix ends where it begins is the next one of its group.

``suffix_order`` does this for one text. ``suffix_orders`` does it for many short texts at once, a round taking the
current group of every text in one set of numpy operations; its cost is a few operations for each round, not for
each suffix.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: list[int]) -> list[int]:
    """The starts of text's suffixes in ascending order. A text's last symbol must be lower than all others."""
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place, low, high = [0] * n, [0] * n, [0] * n  # by suffix: index in order, first index of its group; by first index: last
    for i, s in enumerate(order):
        place[s] = i
        low[s] = low[order[i - 1]] if i and text[order[i - 1]] == text[s] else i
        high[low[s]] = i
    previous, size = [-1] * n, [1] * n
    top = n - 1
    while top >= 0:
        first = low[order[top]]
        pointers: dict[int, int] = {}
        for s in sorted(order[first : top + 1]):
            p = s - 1
            while p >= 0 and low[p] >= first:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                pointers[p] = pointers.get(p, 0) + 1
                size[p] += size[s]
        levels: dict[int, list[int]] = {}
        for p, c in pointers.items():
            levels.setdefault(c, []).append(p)
        for c in sorted(levels, reverse=True):
            ends = {}
            for p in levels[c]:
                g = low[p]
                e = high[g]
                ends.setdefault(g, e)
                other = order[e]
                order[place[p]], place[other] = other, place[p]
                order[e], place[p] = p, e
                high[g] = e - 1
            for g, e in ends.items():
                new = high[g] + 1
                for i in range(new, e + 1):
                    low[order[i]] = new
                high[new] = e
        top = first - 1
    at = [0] * (n + 1)  # by group: how many are emitted
    ended: list[list[int]] = [[] for _ in range(n + 1)]
    for s in range(n):
        ended[s + size[s]].append(s)
    out = [0] * n
    out[0] = n - 1
    for i in range(n):
        for s in ended[out[i]]:
            g = low[s]
            out[g + at[g]] = s
            at[g] += 1
    return out


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + count[0] - 1, start[1] .. and so on."""
    ends = np.cumsum(count, dtype=start.dtype)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, start.dtype)
    if ends[-1] == len(count) and count.min() == 1:
        return start
    return np.arange(ends[-1], dtype=start.dtype) + np.repeat(start - ends + count, count)


def suffix_orders(text: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """suffix_order of texts that lie one after another, as positions in the whole; each text keeps its own stretch."""
    n, small = len(text), np.int32 if len(text) < 1 << 31 else np.int64  # narrow numbers: the work is bound by memory
    lengths = lengths.astype(small)
    ends = np.cumsum(lengths, dtype=small)
    begin = ends - lengths
    owner = np.repeat(np.arange(len(lengths), dtype=small), lengths)
    key = text.astype(np.int64) + owner.astype(np.int64) * (int(text.max()) + 1)
    order = np.argsort(key, kind="stable").astype(small)
    place = np.empty(n, small)
    place[order] = np.arange(n, dtype=small)
    key = key[order]
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))).astype(small)
    counts = np.diff(np.append(head, n))
    low = np.empty(n, small)
    low[order] = np.repeat(head, counts)
    high = np.zeros(n, small)
    high[head] = head + counts - 1
    previous, size = np.full(n, -1, small), np.ones(n, small)
    is_parent = np.zeros(n, bool)
    active = np.arange(len(lengths))
    top = ends - 1
    while len(active):
        t = top[active]
        first = low[order[t]]
        members = np.sort(order[_ranges(first, t - first + 1)])
        base, mine = low[members], begin[owner[members]]
        # The nearest earlier suffix in a group that is not higher; one in the same group passes on its own.
        p = members - 1
        p[p < mine] = -1
        todo = np.flatnonzero(p >= 0)
        todo = todo[low[p[todo]] > base[todo]]
        while len(todo):
            q = previous[p[todo]]
            p[todo] = q
            todo = todo[q >= 0]
            todo = todo[low[p[todo]] > base[todo]]
        previous[members] = p
        todo = np.flatnonzero(p >= 0)
        todo = todo[low[p[todo]] == base[todo]]
        while len(todo):
            q = previous[previous[members[todo]]]
            previous[members[todo]] = q
            todo = todo[q >= 0]
            todo = todo[low[previous[members[todo]]] == base[todo]]
        p = previous[members]
        has = p >= 0
        if has.any():
            parents, where, c = np.unique(p[has], return_index=True, return_counts=True)
            size[parents] += c * size[members[has][where]]
            g = low[parents]
            by = np.lexsort((c, g))
            parents, c, g = parents[by], c[by], g[by]
            new_group = np.concatenate(([True], g[1:] != g[:-1]))
            at = np.flatnonzero(new_group)
            many = np.diff(np.append(at, len(g)))
            groups = g[at]
            last = high[groups]
            target = _ranges(last - many + 1, many)
            is_parent[parents] = True
            there = order[target]
            displaced = there[~is_parent[there]]
            held = place[parents]
            vacated = held[held < np.repeat(last - many + 1, many)]
            is_parent[parents] = False
            order[vacated] = displaced
            place[displaced] = vacated
            order[target] = parents
            place[parents] = target
            high[groups] = last - many
            block = np.flatnonzero(new_group | np.concatenate(([True], c[1:] != c[:-1])))
            width = np.diff(np.append(block, len(g)))
            low[parents] = np.repeat(target[block], width)
            high[target[block]] = target[block] + width - 1
        top[active] = first - 1
        active = active[first > begin[active]]
    following = np.arange(n, dtype=small) + size
    by = np.argsort(following, kind="stable").astype(small)
    many = np.bincount(following, minlength=n + 1).astype(small)
    begins = (np.cumsum(many) - many).astype(small)
    out, free = np.zeros(n, small), np.arange(n, dtype=small)
    out[begin] = ends - 1
    active, step = np.argsort(lengths, kind="stable"), 0
    sizes = lengths[active]
    while len(active):
        emitted = out[begin[active] + step]
        child = by[_ranges(begins[emitted], many[emitted])]
        # A text's last symbol follows nothing of the next text: its own size ends at the text's end.
        spot = free[low[child]]
        out[spot] = child
        free[low[child]] += 1
        step += 1
        live = np.searchsorted(sizes, step, "right")
        active, sizes = active[live:], sizes[live:]
    return out
