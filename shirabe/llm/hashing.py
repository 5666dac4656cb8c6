"""64-bit hashes of words and windows on whole buffers of text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
GOLDEN, MIX1, MIX2 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
BASE = U64(0xD6E8FEB86659FD93)
INVERSE = U64(pow(int(BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> U64(30))) * MIX1
    x = (x ^ (x >> U64(27))) * MIX2
    return x ^ (x >> U64(31))


SMALL_KEYS = mix(np.arange(1, 0x3001, dtype=U64) * GOLDEN)


def run_hashes(signs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every run ``signs[start:end]``: Horner's rule for all runs at once.

    Prefix sums of the signs' keys times powers of an odd base, moved back to the run's start.
    """
    if not len(starts):
        return np.zeros(0, U64)
    n = len(signs)
    keys = SMALL_KEYS[np.minimum(signs, len(SMALL_KEYS) - 1)]
    large = signs >= len(SMALL_KEYS)
    if large.any():
        keys[large] = mix((signs[large].astype(U64) + U64(1)) * GOLDEN)
    powers = np.empty(n + 1, U64)
    powers[0] = 1
    np.multiply.accumulate(np.full(n, BASE, U64), out=powers[1:])
    sums = np.zeros(n + 1, U64)
    np.cumsum(keys * powers[:-1], out=sums[1:])
    powers[0] = 1
    np.multiply.accumulate(np.full(n, INVERSE, U64), out=powers[1:])
    return mix((sums[ends] - sums[starts]) * powers[starts] + (ends - starts).astype(U64) * GOLDEN)


def slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive stretches of at most ``limit``, of one item at least."""
    lo, held = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and held + n > limit:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes)
