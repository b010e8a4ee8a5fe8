"""Suffix arrays over the words of many texts at once, by prefix doubling in arrays."""

from __future__ import annotations

import numpy as np


def word_suffixes(ids: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix order of the words, and the rank of each word's next 1, 2, 4, ... words.

    ``ids`` are hashes that differ between texts, ``text`` the number of each word's text,
    ascending. Two positions have the same rank at level k only where their 2**k words are
    equal and lie in one text. Only positions that still share a rank are sorted again.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    fresh = np.flatnonzero(np.concatenate([[True], ids[order][1:] != ids[order][:-1]])) if n else np.zeros(0, np.int64)
    rank = np.empty(n, np.int64)
    sizes = np.diff(np.append(fresh, n))
    rank[order] = np.repeat(fresh, sizes)
    levels, step = [rank], 1
    active = order[np.repeat(sizes > 1, sizes)]
    while len(active):
        ahead = active + step
        inside = ahead < n
        inside[inside] = text[ahead[inside]] == text[active[inside]]
        second = np.zeros(len(active), np.int64)
        second[inside] = rank[ahead[inside]] + 1
        key = rank[active] << 32 | second
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        new_group = np.concatenate([[True], key[1:] >> 32 != key[:-1] >> 32])
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        at = np.arange(len(active))
        group_at, key_at = np.flatnonzero(new_group), np.flatnonzero(new_key)
        begin = np.repeat(group_at, np.diff(np.append(group_at, len(active))))
        sizes = np.diff(np.append(key_at, len(active)))
        offset = np.repeat(key_at, sizes) - begin
        base = rank[active]
        order[base + (at - begin)] = active
        rank = rank.copy()
        rank[active] = base + offset
        levels.append(rank)
        # a suffix that ends within the step is told apart by its end; it shares a rank with none but itself
        active = active[np.repeat(sizes > 1, sizes)]
        step *= 2
    return order, levels


def neighbour_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Common prefix, in words, of each suffix with the one before it in order (0 for the first)."""
    n = len(order)
    common = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    live = np.arange(n - 1) if n else np.zeros(0, np.int64)
    live = live[levels[0][a] == levels[0][b]] if n else live
    for k in range(len(levels) - 1, -1, -1):
        x, y = a[live], b[live]
        ok = (x < n) & (y < n)
        same = np.zeros(len(live), bool)
        same[ok] = levels[k][x[ok]] == levels[k][y[ok]]
        hit = live[same]
        common[hit + 1] += 1 << k
        a[hit] += 1 << k
        b[hit] += 1 << k
    return common


def longest_repeats(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each position, the words of the deepest LCP interval its suffix lies in."""
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(common, np.append(common[1:], 0)) if len(order) else common
    return out
