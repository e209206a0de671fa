"""The cutting-stock problem over a histogram of lengths, by column generation.

The linear program chooses how often each pattern (a filling of one sequence) is used; a knapsack
by dynamic programming prices new patterns with the program's dual values. Its input is a bounded
histogram (one count for each length class), so it runs on the driver at any corpus size.
"""

from __future__ import annotations

import numpy as np


def best_pattern(value: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable filling with any number of each class: value and count by class."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for w in range(1, capacity + 1):
        best[w] = best[w - 1]
        if k := fits[w]:
            got = best[w - sizes[:k]] + value[:k]
            i = int(got.argmax())
            if got[i] > best[w] + 1e-12:
                best[w], choice[w] = got[i], i
    counts, w = np.zeros(len(sizes), dtype=np.int64), capacity
    while w > 0:
        if choice[w] < 0:
            w -= 1
        else:
            counts[choice[w]] += 1
            w -= sizes[choice[w]]
    return float(best[capacity]), counts


def linear_program(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3, most: int = 4000) -> list[tuple[np.ndarray, float]]:
    """Patterns with the (fractional) number of their uses, within `gap` of the optimum.

    A revised simplex: the basis holds one pattern for each class, and its inverse is updated by
    the entering pattern.
    """
    n = len(sizes)
    patterns = [np.eye(n, dtype=np.int64)[i] * (capacity // sizes[i]) for i in range(n)]
    inverse = np.diag([1.0 / p[i] for i, p in enumerate(patterns)])
    uses = inverse @ demand
    for _ in range(most):
        value, column = best_pattern(np.maximum(inverse.sum(axis=0), 0), sizes, capacity)
        if value <= 1 + gap:  # the program's optimum is at least its value over this
            break
        d = inverse @ column
        grow = d > 1e-9
        if not grow.any():
            break
        ratio = np.where(grow, uses / np.where(grow, d, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        uses = np.maximum(uses - step * d, 0)
        uses[out] = step
        row = inverse[out] / d[out]
        inverse -= np.outer(d, row)
        inverse[out] = row
        patterns[out] = column
    return list(zip(patterns, uses))


def best_fit(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[np.ndarray]:
    """The rest after rounding, largest first into the fullest sequence with room. At most a few items for each class."""
    free: dict[int, list[int]] = {}
    bins: list[np.ndarray] = []
    for i in range(len(sizes) - 1, -1, -1):
        for _ in range(int(left[i])):
            room = min((r for r in free if r >= sizes[i]), default=None)
            if room is None:
                bins.append(np.zeros(len(sizes), dtype=np.int64))
                at, room = len(bins) - 1, capacity
            else:
                at = free[room].pop()
                if not free[room]:
                    del free[room]
            bins[at][i] += 1
            if rest := int(room - sizes[i]):
                free.setdefault(rest, []).append(at)
    return bins


def solve(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (class -> pieces) with their whole numbers of uses; together they hold every piece exactly once."""
    sizes = np.array(sorted(histogram), dtype=np.int64)
    if not len(sizes):
        return []
    demand = np.array([histogram[s] for s in sizes], dtype=np.int64)
    left, out = demand.copy(), []
    for pattern, uses in linear_program(sizes, demand.astype(float), capacity):
        held = pattern > 0
        times = min(int(uses + 1e-6), int((left[held] // pattern[held]).min()) if held.any() else 0)
        if times > 0:
            left -= times * pattern
            out.append((pattern, times))
    out += [(b, 1) for b in best_fit(sizes, left, capacity)]
    return [({int(sizes[i]): int(p[i]) for i in np.flatnonzero(p)}, n) for p, n in out]
