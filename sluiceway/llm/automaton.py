"""What of a page its repeated substrings cover: a suffix automaton over its words, and a suffix array that tests hold against it."""

from __future__ import annotations

import numpy as np

#: Words from which on a page is huge; nothing changes there (a test sets it and compares).
AUTOMATON_WORDS = 50_000


def repeat_cover(words: list, sizes: list[int]) -> tuple[int, int, int]:
    """Characters covered by maximal repeats, by those of two words or more, and by those that occur three times."""
    return tuple(int(np.dot(sizes, marks)) if len(words) else 0 for marks in repeat_marks(words))


def repeat_marks(words: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each word lies in a maximal repeat, in one of two words or more, and in one that occurs three times.

    The automaton is built over all the words of a page of any size. For every position the longest
    stretch that ends there and occurs twice (or three times) or more is a maximal repeat on its
    other side, and is marked wholly; that gives the union of all repeats. No words give three empty arrays.
    """
    return tuple(np.array(marks, dtype=bool) for marks in _automaton_marks(words))


def _automaton_marks(words: list) -> tuple[list[bool], list[bool], list[bool]]:
    """``repeat_marks`` as lists."""
    n = len(words)
    ends, reach, thrice = _automaton(words)
    out = ([False] * n, [False] * n, [False] * n)
    left = left_long = left_often = n
    for i in range(n - 1, -1, -1):  # union of the intervals, from the right
        e = ends[i]
        r = reach[e]
        if r:
            left = min(left, i - r + 1)
            if r > 1:
                left_long = min(left_long, i - r + 1)
        if thrice[e]:
            left_often = min(left_often, i - thrice[e] + 1)
        out[0][i], out[1][i], out[2][i] = i >= left, i >= left_long, i >= left_often
    return out


def _automaton(words: list) -> tuple[list[int], list[int], list[int]]:
    """The state of each prefix, and each state's longest suffix that occurs twice, and three times.

    Builds the suffix automaton (online, linear) and counts each state's occurrences along the suffix links.
    """
    nxt: list[dict] = [{}]
    link, length = [-1], [0]
    last = 0
    ends = []
    for w in words:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        ends.append(cur)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(nxt[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(w) == q:
                    nxt[p][w] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    n = len(nxt)
    count = [0] * n
    for s in ends:
        count[s] = 1
    order = sorted(range(1, n), key=length.__getitem__)
    for s in reversed(order):
        count[link[s]] += count[s]
    reach, thrice = [0] * n, [0] * n
    for s in order:
        reach[s] = length[s] if count[s] >= 2 else reach[link[s]]
        thrice[s] = length[s] if count[s] >= 3 else thrice[link[s]]
    return ends, reach, thrice


def _array_marks(words: list) -> tuple[list[bool], list[bool], list[bool]]:
    """``repeat_marks`` by a suffix array (prefix doubling) and its common prefixes: a check on the automaton, no query uses it."""
    n = len(words)
    number: dict = {}
    rank = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    step = 1
    while True:
        after = np.full(n, -1, dtype=np.int64)
        after[: n - step] = rank[step:]
        order = np.lexsort((after, rank))
        a, b = rank[order], after[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))])
        rank = new
        step *= 2
        if rank.max() == n - 1 or step >= n:
            break
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    codes = [number[w] for w in words]
    lcp = [0] * (n + 1)  # lcp[r]: common prefix of the suffixes at places r - 1 and r
    h = 0
    order_l, place_l = order.tolist(), place.tolist()
    for i in range(n):
        r = place_l[i]
        if r == 0:
            h = 0
            continue
        j = order_l[r - 1]
        while i + h < n and j + h < n and codes[i + h] == codes[j + h]:
            h += 1
        lcp[r] = h
        h = max(0, h - 1)
    c = np.array([0, 0, *lcp, 0], dtype=np.int64)  # c[r + 2] = lcp[r]
    r = place + 2
    two = np.maximum(c[r], c[r + 1])
    three = np.maximum(np.maximum(np.minimum(c[r - 1], c[r]), np.minimum(c[r], c[r + 1])), np.minimum(c[r + 1], c[np.minimum(r + 2, len(c) - 1)]))

    def union(reach: np.ndarray) -> list[bool]:
        edge = np.zeros(n + 1, dtype=np.int64)
        at = np.flatnonzero(reach)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + reach[at], -1)
        return (np.cumsum(edge[:n]) > 0).tolist()

    return union(two), union(np.where(two > 1, two, 0)), union(three)
