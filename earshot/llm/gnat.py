"""GNAT: a geometric near-neighbour access tree over integer vectors, searched in batches.

A node keeps some of its entries as split points; every other entry goes to the child of its
nearest split point. For each split point and child the node stores the least and greatest
distance from that point to the child's entries. A query measures its distances to the split
points and leaves out every child that lies, for some split point, wholly further from it than
the best distance so far allows (triangle inequality).

Results are exact. Squared distances are integers. Roots used for leaving out are floating
point and rounded outwards (``SLACK``), and a child goes only where the bound is strictly
beyond the best distance, so an entry at the same distance is always looked at; equal squared
distances go to the lower index by an integer comparison.
"""

from __future__ import annotations

import numpy as np

SPLITS = 8
LEAF = 12  # entries a node may hold without split points
SLACK = 2.0 ** -40  # relative; roots and their sums err by less than 2**-50


class Node:
    """Entries ``at`` of a table. A leaf holds all of them, an inner node its split points and children."""

    def __init__(self, table: np.ndarray, at: np.ndarray) -> None:
        self.at, self.children = at, []
        if len(at) <= LEAF:
            return
        chosen = far_apart(table[at])
        self.at, rest = at[chosen], np.delete(at, chosen)
        gaps = squared(table[rest], table[self.at])
        home = gaps.argmin(axis=1)
        roots = np.sqrt(gaps.astype(float))
        for j in range(len(chosen)):
            mine = home == j
            if mine.any():
                self.children.append((
                    Node(table, rest[mine]), roots[mine].min(axis=0) * (1 - SLACK), roots[mine].max(axis=0) * (1 + SLACK)))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b, as integers."""
    out = np.zeros((len(a), len(b)), np.int64)
    for x, y in zip(a.T, b.T):
        step = x[:, None] - y[None, :]
        out += step * step
    return out


def far_apart(rows: np.ndarray) -> np.ndarray:
    """Places of ``SPLITS`` rows, each as far as can be from those before it; fewer where only copies are left."""
    chosen = [0]
    nearest = squared(rows, rows[:1])[:, 0]
    while len(chosen) < SPLITS:
        far = int(nearest.argmax())
        if nearest[far] == 0:
            break
        chosen.append(far)
        nearest = np.minimum(nearest, squared(rows, rows[far:far + 1])[:, 0])
    return np.array(chosen)


class Tree:
    """Nearest entry of a table for each of many queries."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table.astype(np.int64)
        # equal entries can't be told apart: the first stands for them
        _, first = np.unique(self.table, axis=0, return_index=True)
        self.root = Node(self.table, np.sort(first))

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index of the nearest entry (the lower of equal ones), its squared distance, and how many distances that took."""
        queries = queries.astype(np.int64)
        best = np.full(len(queries), np.iinfo(np.int64).max)
        index = np.full(len(queries), len(self.table), np.int64)
        measured = 0
        if not len(queries):
            return index, best, measured
        todo = [(self.root, np.arange(len(queries)), None)]
        while todo:
            node, who, least = todo.pop()
            if least is not None:  # the best may have come nearer since this child was put here
                near = least <= roots(best[who])
                who = who[near]
                if not len(who):
                    continue
            gaps = squared(queries[who], self.table[node.at])
            measured += gaps.size
            lowest = gaps.min(axis=1)
            # entries stand in ascending order only in a leaf: take the least index among the nearest
            place = np.where(gaps == lowest[:, None], node.at[None, :], len(self.table)).min(axis=1)
            better = (lowest < best[who]) | ((lowest == best[who]) & (place < index[who]))
            best[who[better]], index[who[better]] = lowest[better], place[better]
            if not node.children:
                continue
            reach, own = roots(best[who]), np.sqrt(gaps.astype(float))
            low, high = own * (1 - SLACK), own * (1 + SLACK)
            bounds = []
            for child, nearest, furthest in node.children:
                # some entry of the child may be as near as this, but none nearer
                least = np.maximum(low - furthest[None, :], nearest[None, :] - high).max(axis=1)
                bounds.append((child, least, least <= reach))
            # children most queries are close to are taken first
            bounds.sort(key=lambda b: -float(np.mean(b[1])))
            todo += [(child, who[stays], least[stays]) for child, least, stays in bounds if stays.any()]
        return index, best, measured


def roots(squares: np.ndarray) -> np.ndarray:
    """Square roots, rounded up."""
    return np.sqrt(squares.astype(float)) * (1 + SLACK)
