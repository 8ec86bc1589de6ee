"""Words of whole text batches as numpy arrays; helpers for Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes that belong to words, per rule; UTF-8 bytes of non-ASCII characters always do.
_BYTES = np.arange(256)
NON_SPACE = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
ALNUM = (
    ((_BYTES >= 0x30) & (_BYTES <= 0x39))
    | ((_BYTES >= 0x41) & (_BYTES <= 0x5A))
    | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))
    | (_BYTES >= 0x80)
)
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)

# odd, so that it has an inverse modulo 2**64
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}
_INVERSE = pow(_BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the longest table so far is kept for the next batch."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1), base, dtype=np.uint64)
        known[0] = 1
        _POWERS[base] = np.multiply.accumulate(known, out=known)
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of several documents.

    data: bytes of all texts, each ended by a space; starts, ends: byte range of each word; hashes: 64-bit
    hash of each word; first: index of each document's first word, with the total at the end.
    """

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def split_words(texts: list[bytes], member: np.ndarray, lower: bool = False) -> Words:
    """Cut texts into maximal runs of ``member`` bytes and hash every run."""
    data = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    if lower:
        data = LOWER[data]
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    inside = member[data]
    # every text ends in a space, so runs never touch the end of the data or another document
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[0::2], edges[1::2]
    hashes = np.zeros(len(starts), dtype=np.uint64)
    if len(starts):
        sums = data.astype(np.uint64)
        sums += np.uint64(1)
        sums *= powers(_BASE, len(data))
        np.cumsum(sums, out=sums)
        before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
        hashes = (sums[ends - 1] - before) * powers(_INVERSE, len(data))[starts]
        hashes = mix(hashes + (ends - starts).astype(np.uint64))
    return Words(data, starts, ends, hashes, np.searchsorted(starts, bounds))


def encoded(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes of text each; a longer single text stays whole."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        slot = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(slot)) + 1), len(sizes)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)
