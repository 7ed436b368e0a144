"""Hashes of words and word sequences, on numpy arrays."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

U = np.uint64
_GOLD = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text that are hashed at once; a longer document is hashed whole.
CHUNK = 1 << 17
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 (the finaliser of splitmix64)."""
    x = x.astype(U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^k and base^-k modulo 2^64 for k < n (base is odd)."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        _powers[base] = tuple(
            np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, U(b))])) for b in (base, inverse)
        )
    up, down = _powers[base]
    return up[:n], down[:n]


def _hash_chunk(text: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word: differences of a prefix sum of bytes times powers."""
    b = np.frombuffer(text, np.uint8)
    space = np.ones(len(b) + 2, np.int8)
    space[1:-1] = _SPACE[b]
    edges = np.flatnonzero(np.diff(space))
    starts, ends = edges[0::2], edges[1::2]
    up, down = powers(_GOLD, len(b) + 1)
    total = np.zeros(len(b) + 1, U)
    np.cumsum((_LOWER[b] if lower else b).astype(U) * up[:-1] + up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] ^ (ends - starts).astype(U) * U(_GOLD)), starts


def hash_words(texts: Sequence[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts end to end, and the number of words of each text."""
    hashes, counts, at = [], [], 0
    while at < len(texts):
        size, to = 0, at
        while to < len(texts) and (to == at or size + len(texts[to]) <= CHUNK):
            size += len(texts[to]) + 1
            to += 1
        part = texts[at:to]
        h, starts = _hash_chunk(b"\n".join(part), lower)
        ends = np.cumsum([len(t) + 1 for t in part])
        counts.append(np.diff(np.searchsorted(starts, ends), prepend=0))
        hashes.append(h)
        at = to
    if not hashes:
        return np.empty(0, U), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(counts)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words; of the whole sequence if it is shorter."""
    n = len(words)
    if not n:
        return np.empty(0, U)
    size = min(width, n)
    h = np.full(n - size + 1, U(size), U)
    for k in range(size):
        h = mix(h * U(_GOLD) + words[k : n - size + 1 + k])
    return np.unique(h)


def windows(words: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A hash of every run of ``width`` words, from prefix sums of a polynomial modulo 2^64."""
    n = len(words)
    if n < width:
        return np.empty(0, U)
    up, down = powers((_GOLD + 8 * seed) % (1 << 64), n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum(mix(words + U(seed)) * up[:n], out=total[1:])
    return mix((total[width:] - total[:-width]) * down[: n - width + 1])


def by_range(hashes: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """(range, first, end) of the equal ranges of the hash space that sorted hashes fall into; empty ones are not visited."""
    if not len(hashes):
        return []
    number = np.minimum(hashes // U((1 << 64) // ranges), U(ranges - 1)).astype(np.int64) if ranges > 1 else np.zeros(len(hashes), np.int64)
    first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    return list(zip(number[first].tolist(), first.tolist(), [*first[1:].tolist(), len(hashes)], strict=True))
