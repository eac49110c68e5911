"""Vectorised word windows: 64-bit word hashes and rolling hashes over batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from xxhash import xxh3_64_intdigest

MIX = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every bit."""
    x = x + MIX
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def chunks(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most `limit` bytes together, or one document."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Order-dependent hash of each `width` consecutive word hashes.

    Windows are combined by doubling, so the cost is logarithmic in `width`.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    level, size, at = mix64(hashes), 1, 0
    out, rest = None, width
    while rest:
        if rest & 1:
            part = level[at : at + n]
            out = part if out is None else mix64(out * MIX + part)
            at += size
        rest >>= 1
        if rest:
            level = mix64(level[:-size] * MIX + level[size:])
            size *= 2
    return out


def within(counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that lie in one document, and their documents.

    counts: words of each document, which follow each other.
    """
    n = np.maximum(counts - width + 1, 0)
    docs = np.repeat(np.arange(len(counts)), n)
    first = np.cumsum(counts) - counts
    ahead = np.cumsum(n) - n
    return np.arange(n.sum()) - np.repeat(ahead, n) + np.repeat(first, n), docs


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)
