"""Configuration linear program of packing: which lengths share a sequence, and how often.

The input is a histogram: how many pieces there are of each length up to the capacity. A
configuration is a multiset of lengths that fits into one sequence. The program asks for the
least number of sequences whose configurations hold all pieces.

Multiplicative weights solve it: a length weighs less the more of its pieces are covered,
``exp(-EPSILON * covered)`` over its number of pieces. Pricing is a knapsack over the
capacity by dynamic programming; one table of it gives, for every length, the best
configuration that holds it, and all configurations within ``EPSILON`` of the best one that
share no length are taken up together before weights change. Weights over the value of the
best configuration are a dual solution; kept is the greatest of these, of their mean over the
later pricings, and of the lengths themselves over the capacity. Rounding takes whole sequences of the configurations that are
tight under it (complementary slackness), in order of their share and as far as pieces are
left, fills up their room with the longest pieces that fit, and the program is solved again for what is left while that gets less. What remains is completed greedily: the
longest piece, then the lengths that fill the rest best (subset sums), as often as there are
pieces for it; each such step uses up a length, so their number does not grow with the counts.
"""

from __future__ import annotations

from collections import Counter

import numpy as np

EPSILON = 0.25
TARGET = 12  # how often each length is to be covered before the shares are read off
TIGHT = 0.98  # value under the dual from which a configuration may be taken when rounding
MOST_PRICINGS = 60  # of one solution; rounding keeps to whole pieces whatever the shares are
Configuration = tuple[tuple[int, int], ...]  # (length, pieces of it), longest first


def priced(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int], list[int]]:
    """Knapsack with any number of each size (ascending): best value by capacity, the size taken last, the capacity left."""
    best = np.zeros(capacity + 1)
    took, left = [-1] * (capacity + 1), [0] * (capacity + 1)
    fitting = np.searchsorted(sizes, np.arange(capacity + 1), side="right").tolist()
    for c in range(1, capacity + 1):
        k = fitting[c]
        best[c], took[c], left[c] = best[c - 1], took[c - 1], left[c - 1]
        if k:
            value = best[c - sizes[:k]] + values[:k]
            j = int(value.argmax())
            if value[j] > best[c]:
                best[c], took[c], left[c] = value[j], j, c - int(sizes[j])
    return best, took, left


def shares(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[dict[tuple[int, ...], float], np.ndarray]:
    """Configurations (ascending places in ``sizes``, repeats included) with their numbers of sequences, and a dual solution.

    The dual's values of no configuration add up to more than one, so over all pieces they are a lower bound.
    """
    covered = np.zeros(len(sizes))
    found: dict[tuple[int, ...], float] = {}
    duals = [sizes / capacity]
    for _ in range(MOST_PRICINGS):
        short = covered < TARGET
        if not short.any():
            break
        low = covered[short].min()
        weights = np.where(short, np.exp(-EPSILON * (covered - low)), 0.0) / demand
        best, took, left = priced(sizes, weights, capacity)
        duals.append(weights / best[capacity])
        holding = weights + best[capacity - sizes]
        near = np.flatnonzero(short & (holding >= (1 - EPSILON) * best[capacity]))
        touched = np.zeros(len(sizes), bool)
        for i in near[np.argsort(-holding[near], kind="stable")].tolist():
            if touched[i]:
                continue
            items, c = [i], capacity - int(sizes[i])
            while took[c] >= 0:
                items.append(took[c])
                c = left[c]
            items.sort()
            if touched[items].any():
                continue
            at, copies = np.unique(items, return_counts=True)
            times = float((demand[at] / copies).min())
            found[tuple(items)] = found.get(tuple(items), 0.0) + times
            covered[at] += times * copies / demand[at]
            touched[at] = True
    return {k: v / TARGET for k, v in found.items()}, max([*duals, np.mean(duals[1 + len(duals) // 2:] or duals, axis=0)], key=lambda d: float((d * demand).sum()))


def completed(left: dict[int, int], capacity: int) -> Counter:
    """Configurations for the pieces that are left: the longest one, and the lengths that fill its rest best."""
    left = dict(sorted(left.items(), reverse=True))
    out: Counter[Configuration] = Counter()
    while left:
        first = next(iter(left))
        room = capacity - first
        held = Counter([first])
        # sums that the lengths so far can make, one bit each; longer lengths come first
        reach, before, mask = 1, [], (1 << (room + 1)) - 1
        for size, n in left.items():
            if size > room:
                continue
            n -= size == first
            copies = 1
            while n > 0 and not reach >> room & 1:
                step = min(copies, n)
                if step * size > room:
                    break
                before.append((size, step, reach))
                reach |= reach << step * size & mask
                n -= step
                copies *= 2
            if reach >> room & 1:
                break
        total = reach.bit_length() - 1
        for size, step, earlier in reversed(before):
            if not earlier >> total & 1:
                total -= step * size
                held[size] += step
        times = min(left[s] // n for s, n in held.items())
        for s, n in held.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
        out[tuple(sorted(held.items(), reverse=True))] += times
    return out


def filled(needs: Counter, left: dict[int, int], capacity: int) -> Counter | None:
    """A configuration with the longest pieces that still fit beside it, or None where its own are not left."""
    if any(left[s] < n for s, n in needs.items()):
        return None
    room = capacity - sum(s * n for s, n in needs.items())
    held = Counter(needs)
    for s in reversed(left):  # ascending by length
        more = min(room // s, left[s] - held[s])
        if more > 0:
            held[s] += more
            room -= s * more
    return held


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[Configuration, int]], float]:
    """Configurations with their numbers of sequences, which hold exactly the pieces of the histogram, and a lower bound on sequences."""
    left = {s: n for s, n in sorted(histogram.items()) if n > 0}
    out: Counter[Configuration] = Counter()
    bound = None
    while left:
        sizes, demand = np.array(list(left)), np.array(list(left.values()), float)
        found, dual = shares(sizes, demand, capacity)
        bound = float((dual * demand).sum()) if bound is None else bound
        before = sum(s * n for s, n in left.items())
        ranked = sorted((f for f in found.items() if dual[list(f[0])].sum() >= TIGHT), key=lambda f: -f[1])
        for whole in (True, False):
            for items, x in ranked:
                needs = Counter(sizes[list(items)].tolist())
                wanted = int(x) if whole else 1
                while wanted > 0:
                    held = filled(needs, left, capacity)
                    times = min(wanted, *(left[s] // n for s, n in held.items())) if held else 0
                    if not times:
                        break
                    wanted -= times
                    out[tuple(sorted(held.items(), reverse=True))] += times
                    for s, n in held.items():
                        left[s] -= n * times
        left = {s: n for s, n in left.items() if n}
        # another solution while the last one placed most of what there was
        if 2 * sum(s * n for s, n in left.items()) > before:
            break
    out += completed(left, capacity)
    return sorted(out.items(), reverse=True), bound or 0.0
