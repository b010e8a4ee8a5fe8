"""Boosted trees over yes/no features, fitted on counts of feature patterns.

Rows with equal features are one pattern, so the fit needs only (pattern, label, count). A
tree asks one feature and then one more on either side; leaf values are Newton steps for the
logistic loss. A model is a list of trees and becomes a column expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TREES, RATE, PENALTY = 40, 0.3, 1.0
Tree = tuple[int, tuple[int, float, float], tuple[int, float, float]]  # feature, then (feature, no, yes) for no and yes


def fit(counts: dict[tuple[int, bool], int], features: int) -> list[Tree]:
    """Trees from counts by (pattern, label); feature f of a pattern is its bit f."""
    patterns = sorted({p for p, _ in counts})
    margin = dict.fromkeys(patterns, 0.0)
    trees: list[Tree] = []
    for _ in range(TREES):
        grads = {}
        for p in patterns:
            yes, no = counts.get((p, True), 0), counts.get((p, False), 0)
            prob = 1 / (1 + math.exp(-margin[p]))
            grads[p] = yes - (yes + no) * prob, (yes + no) * prob * (1 - prob)

        def split(members: list[int]) -> tuple[float, int, float, float]:
            g, h = (sum(grads[p][k] for p in members) for k in (0, 1))
            best = (-1.0, 0, 0.0, 0.0)
            for f in range(features):
                g1 = sum(grads[p][0] for p in members if p >> f & 1)
                h1 = sum(grads[p][1] for p in members if p >> f & 1)
                gain = (g - g1) ** 2 / (h - h1 + PENALTY) + g1 * g1 / (h1 + PENALTY)
                if gain > best[0] + 1e-12:
                    best = gain, f, RATE * (g - g1) / (h - h1 + PENALTY), RATE * g1 / (h1 + PENALTY)
            return best

        chosen = None
        for f in range(features):
            sides = [[p for p in patterns if (p >> f & 1) == s] for s in (0, 1)]
            found = [split(s) for s in sides]
            gain = sum(x[0] for x in found)
            if chosen is None or gain > chosen[0] + 1e-12:
                chosen = gain, (f, found[0][1:], found[1][1:])
        trees.append(chosen[1])
        for p in patterns:
            margin[p] += value(chosen[1], p)
    return trees


def value(tree: Tree, pattern: int) -> float:
    f, low, high = tree
    g, no, yes = high if pattern >> f & 1 else low
    return yes if pattern >> g & 1 else no


def margin(trees: list[Tree], pattern: int) -> float:
    total = 0.0
    for t in trees:  # in the order of margin_column, without the compensation of sum()
        total += value(t, pattern)
    return total


def margin_column(trees: list[Tree], pattern: Column) -> Column:
    """The margin of a pattern column."""
    def leaf(part: tuple[int, float, float]) -> Column:
        return F.when(pattern.bitwiseAND(F.lit(1 << part[0])) != 0, part[2]).otherwise(part[1])

    total = F.lit(0.0)
    for f, low, high in trees:
        total = total + F.when(pattern.bitwiseAND(F.lit(1 << f)) != 0, leaf(high)).otherwise(leaf(low))
    return total


def threshold(held: list[tuple[float, bool, int]], precision: float) -> float:
    """Margin from which the held-out rows (margin, label, count) are right often enough.

    It lies halfway from the least such margin to the next lower one, or to 0 where there is
    none. The share of right ones is drawn towards one half by one row, so that a few rows
    prove nothing; without a margin that is good enough nothing passes.
    """
    best, right, n = math.inf, 0, 0
    totals: dict[float, list[int]] = {}
    for m, label, count in held:
        t = totals.setdefault(m, [0, 0])
        t[0] += count if label else 0
        t[1] += count
    margins = sorted(totals, reverse=True)
    for m, below in zip(margins, [*margins[1:], 0.0]):
        right += totals[m][0]
        n += totals[m][1]
        if (right + 0.5) / (n + 1) >= precision:
            best = (m + min(m, below)) / 2
    return best
