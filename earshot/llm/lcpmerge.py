"""Sorted runs of strings, front-coded, and their merge by a loser tree that knows prefixes.

All strings have the same length. A run keeps each string as the length of the prefix it
shares with the one before and the bytes after it. In the tree every waiting string carries
the length of the prefix it shares with the last string given out. Of two strings the one
that shares more comes first, without a look at either; only for equal lengths are bytes
compared, from there on, so that no known prefix is compared again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def sort_order(strings: np.ndarray) -> np.ndarray:
    """Order of the rows of a byte matrix whose width is a multiple of 8."""
    words = np.ascontiguousarray(strings).view(">u8")
    return np.lexsort(words.T[::-1])


def front_coded(strings: np.ndarray) -> tuple[bytes, bytes]:
    """Prefix lengths and remaining bytes of sorted distinct rows, fewer than 256 wide."""
    n, k = strings.shape
    prefix = np.zeros(n, np.uint8)
    if n > 1:
        prefix[1:] = np.argmin(strings[1:] == strings[:-1], axis=1)
    rest = np.arange(k) >= prefix[:, None]
    return prefix.tobytes(), strings[rest].tobytes()


def merged(prefixes: list[bytes], rests: list[bytes], k: int) -> Iterator[tuple[int, int]]:
    """(run, prefix shared with the string before) of all strings of the runs in order; ties by run."""
    runs, total = len(prefixes), sum(map(len, prefixes))
    size = 1 << (runs - 1).bit_length() if runs > 1 else 1
    head = [rests[r][:k] if r < runs and prefixes[r] else b"" for r in range(size)]
    known = [0 if h else -1 for h in head]  # -1: the run is at its end
    place, offset = [1] * size, [k] * size
    ends = [len(prefixes[r]) if r < runs else 0 for r in range(size)]
    loser = [0] * size
    best = list(range(size))
    while len(best) > 1:  # the first tournament, from the leaves
        level = []
        for i in range(0, len(best), 2):
            a, b = best[i], best[i + 1]
            won, lost = _play(a, b, head, known, k)
            loser[(len(best) + i) // 2] = lost
            level.append(won)
        best = level
    now = best[0]
    for _ in range(total):
        yield now, known[now]
        i = place[now]
        if i < ends[now]:
            shared = prefixes[now][i]
            start = offset[now]
            offset[now] = stop = start + k - shared
            head[now] = head[now][:shared] + rests[now][start:stop]
            known[now] = shared
            place[now] = i + 1
        else:
            known[now] = -1
        node = (now + size) >> 1
        while node:
            other = loser[node]
            x, y = known[now], known[other]
            if x < y:
                loser[node], now = now, other
            elif x == y and x >= 0:
                now, loser[node] = _play(now, other, head, known, k)
            node >>= 1


def _play(a: int, b: int, head: list[bytes], known: list[int], k: int) -> tuple[int, int]:
    """Winner and loser; what the loser shares with the winner becomes known."""
    x, y = known[a], known[b]
    if x != y:
        return (a, b) if x > y else (b, a)
    if x < 0:
        return a, b
    s, t, i = head[a], head[b], x
    if i < k and s[i] == t[i]:
        if s[i:] == t[i:]:
            i = k
        else:
            while s[i] == t[i]:
                i += 1
    if i == k:
        won, lost = (a, b) if a < b else (b, a)
    else:
        won, lost = (a, b) if s[i] < t[i] else (b, a)
    known[lost] = i
    return won, lost
