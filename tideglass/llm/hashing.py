"""64-bit hashes of all slices of a byte array, from sums of position-weighted byte codes."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a public 64-bit generator: spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * BASE) | np.uint64(1)
OTHER_CODES = mix(np.arange(1001, 1257, dtype=np.uint64) * BASE) | np.uint64(1)
_powers: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.uint64), np.empty(0, np.uint64))


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        up, down = np.full(n, BASE, dtype=np.uint64), np.full(n, _UNBASE, dtype=np.uint64)
        up[0] = down[0] = 1
        _powers = (np.cumprod(up), np.cumprod(down))
    return _powers


def prefix_sums(points: np.ndarray, codes: np.ndarray = BYTE_CODES) -> np.ndarray:
    up, _ = power_tables(len(points) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes[points] * up[: len(points)])])


def slice_hashes(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the slices begin to end, equal for equal bytes wherever they stand."""
    _, down = power_tables(len(sums))
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
