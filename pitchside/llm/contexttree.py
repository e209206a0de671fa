"""Context-tree weighting over the bytes of whole texts, decomposed into bits.

A text is its bytes and an end byte. The context of a byte is the eight bytes before it in its text, nearest first, across words
and lines; what lies before the text is padding, a byte that UTF-8 never has. So a context is a 64-bit number, its suffix of d
bytes are its highest d bytes, and whatever comes after the first padding byte adds nothing: below it
the tree has one child at every depth with the same counts, for which weighting gives the same.

For every suffix of a context (depths 0 to 8) and every prefix of the next byte's bits there is a node
with two counts and a Krichevsky-Trofimov estimate; a node's weighted probability is half its own
estimate and half the product of its children's (suffixes one byte longer). A prediction mixes the
estimates along the path: from the top down each node adds its share of what the nodes above left over.
Probabilities of a zero and of a one are both summed up, so that a small one is never lost next to a large one.

The functions here take the cells (context, next byte, count) of whole subtrees below depth TOP, sorted
by context. Cells with count 0 ask for a prediction and change no other.
"""

from __future__ import annotations

import numpy as np

DEPTH, TOP = 8, 4
PAD = 0xFF
HALF = np.log(0.5)


def log_gamma(x, log=np.log):
    """By Stirling's series after a shift by eight; of arrays, or of columns with their logarithm."""
    low = x
    for i in range(1, 8):
        low = low * (x + i)
    z = x + 8
    return (z - 0.5) * log(z) - z + 0.5 * float(np.log(2 * np.pi)) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - log(low)


def estimate(a, b, log=np.log):
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return log_gamma(a + 0.5, log) + log_gamma(b + 0.5, log) - float(np.log(np.pi)) - log_gamma(a + b + 1.0, log)


SMALL = 1 << 16
_HALVES, _WHOLES = log_gamma(np.arange(SMALL) + 0.5), log_gamma(np.arange(SMALL) + 1.0)


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same for arrays of whole counts; most are small, and looked up."""
    large = np.flatnonzero(a + b >= SMALL)
    i, j = a, b
    if len(large):
        i, j = a.copy(), b.copy()
        i[large] = j[large] = 0
    out = _HALVES[i]
    out += _HALVES[j]
    out -= _WHOLES[i + j]
    out -= float(np.log(np.pi))
    if len(large):
        out[large] = estimate(a[large].astype(np.float64), b[large].astype(np.float64))
    return out


class Level:
    """The bit nodes of one depth: counts, the cell that stands for each node, and each cell's node at each of the eight bits.

    Cells are those of this depth: its nodes' distinct next bytes, in order of node and byte. A cell stands for all deeper ones with its
    byte below its node; `deepest` is one of them, `up` each cell's number at the depth above.
    """

    def __init__(self, node: np.ndarray, following: np.ndarray, n: np.ndarray, deepest: np.ndarray):
        self.node, self.following, self.n, self.deepest, self.up = node, following, n, deepest, None
        key = node << 8 | following
        differs = np.empty_like(key)  # from the cell before: no bit of the node and byte, the lowest, or higher ones
        differs[:1], differs[1:] = -1 << 62, key[1:] ^ key[:-1]
        zeros, total, cell, self.at = [], [], [], np.empty((8, len(key)), dtype=np.int64)
        sums = np.zeros(len(key) + 1, dtype=np.int64)
        np.cumsum(n, out=sums[1:])
        held = 0
        for level in range(8):
            new = differs >> (8 - level) != 0
            starts = np.flatnonzero(new)
            bounds = np.append(starts, len(key))
            total.append(np.diff(sums[bounds]))
            # a node's zeros come first; they end where the next bit changes within the node, or with it
            change = np.flatnonzero(differs >> (7 - level) != 0)
            place = np.searchsorted(change, starts) if len(change) != len(starts) else np.arange(len(starts))
            end = np.append(change, len(key))[place + 1]
            zeros.append(np.where(following[starts] >> (7 - level) & 1, 0, sums[end] - sums[starts]))
            cell.append(starts)
            np.cumsum(new, out=self.at[level])
            self.at[level] += held - 1
            held += len(starts)
        self.zeros, self.cell = np.concatenate(zeros), np.concatenate(cell)
        self.ones = np.concatenate(total) - self.zeros
        self.bits = np.repeat(np.arange(8), [len(x) for x in cell])
        self.first = deepest[self.cell]
        self.own = estimates(self.zeros, self.ones)

    def heap(self, following: np.ndarray) -> np.ndarray:
        """Number of each node's prefix: 1 for none, then the bits behind a leading one."""
        return 1 << self.bits | following[self.first].astype(np.int64) >> (8 - self.bits)

    def above(self, part: np.ndarray) -> Level:
        """The level of the depth above. part: each deepest cell's context at that depth."""
        own = part[self.deepest]
        node = np.zeros(len(own), dtype=np.int64)
        np.cumsum(own[1:] != own[:-1], out=node[1:])
        key = node << 8 | self.following
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        starts = np.flatnonzero(new)
        self.up = np.empty(len(key), dtype=np.int64)
        self.up[order] = np.cumsum(new) - 1
        key = key[starts]
        return Level(key >> 8, key & 255, np.add.reduceat(self.n[order], starts), self.deepest[order[starts]])

    def parents(self, upper: Level) -> np.ndarray:
        """Each bit node's node at the depth above."""
        return upper.at[self.bits, self.up[self.cell]]


def grown(ctx: np.ndarray, following: np.ndarray, n: np.ndarray) -> tuple[list[Level], list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Levels of depths TOP to DEPTH; for each but the last, share of nodes' own estimates and of their children; log weighted at TOP.

    Cells are distinct, those of a context together and in order of next byte.
    """
    node = np.zeros(len(ctx), dtype=np.int64)
    np.cumsum(ctx[1:] != ctx[:-1], out=node[1:])
    levels = [Level(node, following.astype(np.int64), n.astype(np.int64), np.arange(len(ctx)))]
    for d in range(DEPTH - 1, TOP - 1, -1):
        levels.insert(0, levels[0].above(ctx >> np.uint64(8 * (DEPTH - d))))
    own_share, rest_share = [], []
    weighted = levels[-1].own
    for upper, lower in zip(levels[-2::-1], levels[:0:-1]):
        children = np.bincount(lower.parents(upper), weights=weighted, minlength=len(upper.own))
        less = np.exp(-np.abs(upper.own - children))
        is_own = upper.own >= children
        weighted = np.where(is_own, upper.own, children) + np.log1p(less) + HALF
        high = 1 / (1 + less)
        less *= high
        own_share.insert(0, np.where(is_own, high, less))
        rest_share.insert(0, np.where(is_own, less, high))
    return levels, own_share, rest_share, weighted


def log_probabilities(ctx: np.ndarray, following: np.ndarray, n: np.ndarray, above: tuple[np.ndarray, ...]) -> np.ndarray:
    """log10 of the probability of each cell's byte. above: key (TOP bytes and prefix number), zero, one, rest, for each node of depth TOP."""
    levels, own_share, rest_share, _ = grown(ctx, following, n)
    top = levels[0]
    key = (ctx[top.first] >> np.uint64(8 * (DEPTH - TOP))).astype(np.int64) << 8 | top.heap(following)
    order = np.argsort(above[0])
    row = order[np.searchsorted(above[0], key, sorter=order)]
    zero, one, rest = (x[row] for x in above[1:])
    for i, (upper, lower) in enumerate(zip(levels, levels[1:])):
        parent = lower.parents(upper)
        last = i == len(levels) - 2
        own = rest[parent]
        left = None if last else own * rest_share[i + 1]
        if not last:
            own *= own_share[i + 1]
        own /= lower.zeros + lower.ones + 1
        zero, one = zero[parent] + own * (lower.zeros + 0.5), one[parent] + own * (lower.ones + 0.5)
        rest = left
    out = np.ones(len(ctx))
    for level, at in enumerate(levels[-1].at):
        out *= np.where(following >> (7 - level) & 1, one[at], zero[at])  # eight factors, none below 1 in twice the bits of all texts
    return np.log10(out)
