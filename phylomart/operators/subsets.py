"""Gower sums of items with few traits each, from the subsets of traits that items share.

A pair that shares a trait t and k others weighs its gap in t by 1 / (k + 1), which is the sum over the subsets of those k of (-1)**u / (u + 1), u the
size of the subset. So the sums of an item are sums over the subsets of its own traits: for each, a running sum in the order of t over the items that
have them all. The work grows with the subsets that several items have, not with the pairs of items.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np

# Rows that are held at once for the subsets of one list of items.
SUBSET_ROWS = 1 << 19
# Lists up to this length may be met pair by pair, and how many pairs cost as much as a row of a subset.
PAIR_LIST = 2048
PAIRS_A_ROW = 6


def subset_weight(u: int) -> float:
    return (-1) ** u / (u + 1)


def _by_pairs(x: np.ndarray, rest: np.ndarray, u: int) -> tuple[np.ndarray, np.ndarray]:
    """All subsets of a list at once: those of the r further traits of a pair sum up to (-1)**u * u! * r! / (u + r + 1)!."""
    shared = np.bitwise_count(rest[:, None] & rest[None, :])
    np.fill_diagonal(shared, 0)
    table = np.array([(-1) ** u * factorial(u) * factorial(r) / factorial(u + r + 1) for r in range(int(shared.max(initial=0)) + 1)])
    weight = table[shared]
    np.fill_diagonal(weight, 0.0)
    return (weight * np.abs(x[:, None] - x[None, :])).sum(1), weight.sum(1)


def _by_rows(x: np.ndarray, rest: np.ndarray, u: int) -> tuple[np.ndarray, np.ndarray]:
    """A row for each item and subset of its further traits, a trait after the other; rows of a subset stay side by side, in the order of x.

    A subset that one item has alone meets nobody and is dropped with all that hold it.
    """
    at, has, more = np.arange(len(x), dtype=np.int32), np.zeros(len(x), dtype=np.int64), rest
    all_at, all_has = [at], [has]
    union = int(np.bitwise_or.reduce(rest))
    for round, b in enumerate(_bits(union)):
        if round % 3 == 0:
            left = np.flatnonzero(more >> b)
            at, has, more = at[left], has[left], more[left]
        mine = np.flatnonzero(more & (1 << b))
        if len(mine) < 2:
            continue
        own = has[mine]
        differs = own[1:] != own[:-1]
        alone = np.append(True, differs) & np.append(differs, True)
        if alone.any():
            mine = mine[~alone]
            own = has[mine]
        if not len(mine):
            continue
        own = own | (1 << b)
        all_at.append(at[mine])
        all_has.append(own)
        at, has, more = np.concatenate([at, all_at[-1]]), np.concatenate([has, own]), np.concatenate([more, more[mine]])
    at, has = np.concatenate(all_at), np.concatenate(all_has)
    values = x[at]
    first = np.flatnonzero(np.append(True, has[1:] != has[:-1]))
    size = np.diff(np.append(first, len(has)))
    sizes = np.bitwise_count(has[first]) + u
    weight = np.where(sizes & 1, -1.0, 1.0) / (sizes + 1.0)
    sums = np.cumsum(values)
    below = sums[first] - values[first]
    total = sums[first + size - 1] - below
    gaps = values * (2.0 * np.arange(1, len(has) + 1) - np.repeat(2.0 * first + size, size)) - 2 * sums + np.repeat(total + 2 * below, size)
    gaps *= np.repeat(weight, size)
    return np.bincount(at, gaps, len(x)), np.bincount(at, np.repeat(weight * (size - 1), size), len(x))


def _bits(mask: int) -> Iterator[int]:
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


def subset_sums(x: np.ndarray, rest: np.ndarray, part: int = 0, parts: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """For items that have a trait with values ``x``, in their order, and further traits ``rest`` (bit masks): the summed gaps to all others, each over the number of
    traits that the pair shares, and the sum of one over that number.

    The sums over all ``parts`` add up: a part takes the subsets whose lowest trait falls to it, and the first the empty one.
    """
    total, met = np.zeros(len(x)), np.zeros(len(x))

    def add(at, sums) -> None:
        total[at] += sums[0]
        met[at] += sums[1]

    def alone(at: np.ndarray, u: int) -> None:
        values, n = x[at], len(at)
        below = np.cumsum(values)
        gaps = values * (2.0 * np.arange(1, n + 1) - n) + below[-1] - 2 * below
        add(at, (subset_weight(u) * gaps, subset_weight(u) * (n - 1)))

    def walk(at: np.ndarray, rest: np.ndarray, u: int) -> None:
        rows = np.exp2(np.bitwise_count(rest).astype(float)).sum()
        if len(at) <= PAIR_LIST and len(at) ** 2 <= PAIRS_A_ROW * rows:
            add(at, _by_pairs(x[at], rest, u))
        elif rows <= SUBSET_ROWS:
            add(at, _by_rows(x[at], rest, u))
        else:
            alone(at, u)
            for b in _bits(int(np.bitwise_or.reduce(rest))):
                below(at, rest, b, u)

    def below(at: np.ndarray, rest: np.ndarray, b: int, u: int) -> None:
        some = np.flatnonzero(rest & (1 << b))
        if len(some) > 1:
            walk(at[some], rest[some] & -(2 << b), u + 1)

    if len(x):
        every = np.arange(len(x))
        if part == 0:
            alone(every, 0)
        for b in _bits(int(np.bitwise_or.reduce(rest))):
            if b % parts == part:
                below(every, rest, b, 0)
    return total, met
