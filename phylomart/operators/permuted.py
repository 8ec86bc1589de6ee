"""Moments of a Mantel test by permutation, from numbered tips.

The depth that two tips share is the sum of the branch lengths above both, so a moment with it is a sum over nodes of sums over the pairs below
them, and those of trait gaps are running sums in the order of a trait. A permutation is one unit of work over arrays of all tips; no pair
is formed, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa

DRAWS_AT_ONCE = 65_536


@dataclass
class Level:
    """Nodes at one place of the paths: the ``node`` of each tip, and of each node the branch ``d`` above and the difference ``dd`` of the squared depths at its ends."""

    node: np.ndarray
    d: np.ndarray
    dd: np.ndarray


@dataclass
class Tips:
    """Tips in the order of their items: the items' text and traits (NaN where missing), depths, and the levels where tips part; ``top`` is d and dd of all nodes above every tip."""

    text: pa.Array
    traits: list[np.ndarray]
    end: np.ndarray
    levels: list[Level]
    top: tuple[float, float]


def level(node: np.ndarray, missing: np.ndarray, known: np.ndarray, deep: np.ndarray, above: np.ndarray) -> Level:
    """A level from the ``node`` ids of all tips and the depths at both ends of the branches of ``known`` nodes, those with several tips.

    Nodes are numbered by their first tip, so that levels with the same tips below their nodes are equal; other tips have the last number.
    """
    order = np.argsort(known)
    at = np.minimum(np.searchsorted(known, node, sorter=order), len(known) - 1)
    at = np.where((known[order][at] == node) & ~missing, order[at], len(known))
    numbers, first = np.unique(at, return_index=True)
    by_first = numbers[np.argsort(first)]
    by_first = by_first[by_first < len(known)]
    rank = np.full(len(known) + 1, len(known))
    rank[by_first] = np.arange(len(by_first))
    d, dd = (np.append(x[by_first], 0.0) for x in (deep - above, deep * deep - above * above))
    rank[len(known)] = len(by_first)
    kind = np.uint16 if len(by_first) < 1 << 16 else np.int32
    return Level(rank[at].astype(kind), d, dd)


def joined(levels: Sequence[Level]) -> list[Level]:
    """Levels of which each has other tips below its nodes than the one before: nodes of a chain count as one."""
    out: list[Level] = []
    for one in levels:
        if out and np.array_equal(out[-1].node, one.node):
            out[-1] = Level(one.node, out[-1].d + one.d, out[-1].dd + one.dd)
        else:
            out.append(one)
    return out


def drawn_order(text: pa.Array, seed: int, perm: int) -> np.ndarray:
    """The items in the order of their md5 draws: the item in place r takes the label of the r-th of them. Permutation 0 is the identity."""
    if not perm:
        return np.arange(len(text))
    begin = f"{seed}:{perm}:".encode()
    parts = (text[i : i + DRAWS_AT_ONCE].to_pylist() for i in range(0, len(text), DRAWS_AT_ONCE))
    draws = b"".join([b"".join([md5(begin + t, usedforsecurity=False).digest() for t in part]) for part in parts])
    high, low = np.frombuffer(draws, dtype=">u8").astype(np.uint64).reshape(-1, 2).T
    order = np.argsort(high, kind="stable")
    if (np.diff(high[order]) == 0).any():
        order = np.lexsort((low, high))
    return order


class Permuted:
    """The sums over all pairs that share a trait, for one permutation at a time."""

    def __init__(self, tips: Tips):
        self.tips = tips
        has = np.zeros(len(tips.end), dtype=np.int64)
        for k, x in enumerate(tips.traits):
            has |= np.where(np.isnan(x), 0, 1 << k)
        masks, self.pattern = np.unique(has, return_inverse=True)
        shared = np.array([[int(p & q).bit_count() for q in masks] for p in masks], dtype=float).reshape(len(masks), len(masks))
        self.weight = np.divide(1.0, shared, out=np.zeros_like(shared), where=shared > 0)
        # items in the order of each trait
        self.sorted = []
        for x in tips.traits:
            known = np.flatnonzero(~np.isnan(x))
            at = known[np.argsort(x[known], kind="stable")]
            self.sorted.append((at, x[at], self.pattern[at]))

    def gap_totals(self) -> np.ndarray:
        """The summed trait distance of each item to all others."""
        total = np.zeros(len(self.tips.end))
        for at, x, p in self.sorted:
            for k in np.unique(p):
                own = p == k
                count, below = np.cumsum(own), np.cumsum(np.where(own, x, 0.0))
                total[at] += self.weight[p, k] * (x * (2 * count - count[-1]) + below[-1] - 2 * below)
        return total

    def _gaps_below(self, node: np.ndarray, d: np.ndarray, x: np.ndarray, p: np.ndarray) -> float:
        """Gaps of pairs below the same node, weighted by their patterns and ``d``; rows are in the order of x."""
        order = np.argsort(node, kind="stable")
        node, x, p = node[order], x[order], p[order]
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        begin = np.repeat(first, np.diff(np.append(first, len(node))))
        total = np.zeros(len(x))
        for k in np.unique(p):
            own = p == k
            count, below = np.append(0, np.cumsum(own)), np.append(0.0, np.cumsum(np.where(own, x, 0.0)))
            total += self.weight[p, k] * (x * (count[1:] - count[begin]) - (below[1:] - below[begin]))
        return float(total @ d[node])

    def moments(self, order: np.ndarray, gaps: np.ndarray) -> tuple[float, ...]:
        """n, x, y, yy and xy where the item in place i stands at the tip ``order[i]``; ``gaps`` are the :meth:`gap_totals`."""
        kinds, end = len(self.weight), self.tips.end[order]
        meet = (self.weight > 0).astype(float)

        def ends(node: np.ndarray | int, nodes: int) -> tuple[np.ndarray, ...]:
            """Pairs below each node, and the sums and squared sums of their depths."""
            key = node * np.int64(kinds) + self.pattern
            c, s, q = (np.bincount(key, w, nodes * kinds).reshape(nodes, kinds) for w in (np.ones(len(end)), end, end * end))
            known = np.diag(meet)
            return (
                ((c @ meet * c).sum(1) - c @ known) / 2,
                (c @ meet * s).sum(1) - s @ known,
                (c @ meet * q).sum(1) + (s @ meet * s).sum(1) - 2 * (q @ known),
            )

        (n,), (one,), (two,) = ends(0, 1)
        d, dd = self.tips.top
        x = gaps.sum() / 2
        y, yy, xy = one - 2 * d * n, two - 4 * d * one + 4 * dd * n, float(gaps @ end) - 2 * d * x
        for level in self.tips.levels:
            node = level.node[order]
            pairs, ones, _ = ends(node.astype(np.int64), len(level.d))
            y -= 2 * float(level.d @ pairs)
            yy += 4 * float(level.dd @ pairs - level.d @ ones)
            for at, values, p in self.sorted:
                if len(at):
                    xy -= 2 * self._gaps_below(node[at], level.d, values, p)
        return float(n), float(x), float(y), float(yy), float(xy)

    def squares(self, t: int, u: int) -> float:
        """What the product of the gaps in two traits (or the square of one's) gives to the sum of all squared trait distances."""
        both = np.flatnonzero(~np.isnan(self.tips.traits[t]) & ~np.isnan(self.tips.traits[u]))
        if not len(both):
            return 0.0
        x, y = (self.tips.traits[k][both] for k in (t, u))
        x, y = x - x.mean(), y - y.mean()
        p, weight = self.pattern[both], self.weight**2
        c, sx, sy, sxy = (np.bincount(p, w, len(weight)) for w in (np.ones(len(x)), x, y, x * y))
        every = float(c @ weight @ sxy - sx @ weight @ sy)
        # a product without its sign is twice that of the pairs in the same order in both, less the signed one
        return every if t == u else 2 * (2 * concordant(x, y, p, weight) - every)


def concordant(x: np.ndarray, y: np.ndarray, p: np.ndarray, weight: np.ndarray) -> float:
    """The sum over pairs in the same order of x and of y of the product of their gaps, weighted by their patterns ``p``.

    Rows stand in the order of y within blocks of the order of x that halve from round to round; in a round the rows of a block's upper half meet
    those before them of its lower half by running sums.
    """
    rank = np.empty(len(x), dtype=np.int64)
    rank[np.argsort(x, kind="stable")] = np.arange(len(x))
    order = np.argsort(y, kind="stable")
    rank, x, y, p = rank[order], x[order], y[order], p[order]
    place, total = np.arange(len(x)), 0.0
    for bit in reversed(range(len(x).bit_length())):
        begin = (rank >> (bit + 1)) << (bit + 1)
        lower = (rank >> bit) & 1 == 0
        upper = np.flatnonzero(~lower)
        first, xs, ys, ps = begin[upper], x[upper], y[upper], p[upper]
        for k in np.unique(p):
            own = lower & (p == k)

            def before(value) -> np.ndarray:
                sums = np.append(0.0, np.cumsum(np.where(own, value, 0.0)))
                return sums[upper] - sums[first]

            found = xs * ys * before(1.0) - xs * before(y) - ys * before(x) + before(x * y)
            total += float(weight[ps, k] @ found)
        # the next round's order: a block's lower half, then its upper half
        lows = np.append(0, np.cumsum(lower))[:-1]
        lows -= lows[begin]
        to = begin + np.where(lower, lows, np.minimum(1 << bit, len(x) - begin) + place - begin - lows)
        moved = np.empty_like(place)
        moved[to] = place
        rank, x, y, p = rank[moved], x[moved], y[moved], p[moved]
    return total
