"""Hashes of word runs of a text, computed over its bytes in array operations."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
#: Words of a text handled at once; longer texts go piece by piece, so memory stays bounded.
PIECE = 100_000
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def run_hashes(words: list[str], size: int) -> np.ndarray:
    """Hash of each run of size consecutive words, by its start; of all words, once, if they are fewer; none of none."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    size = min(size, len(words))
    if len(words) > PIECE:
        return np.concatenate([_run_hashes(words[i : i + PIECE + size - 1], size) for i in range(0, len(words) - size + 1, PIECE)])
    return _run_hashes(words, size)


def _run_hashes(words: list[str], size: int) -> np.ndarray:
    data = " ".join(words).encode()
    a = np.frombuffer(data, dtype=np.uint8)
    up, down = _power_tables(len(a) + 1)
    prefix = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64, out=prefix[1:])
    gaps = np.flatnonzero(a == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(a)]))
    s, e = starts[: len(starts) - size + 1], ends[size - 1 :]
    return mix((prefix[e] - prefix[s]) * down[s] + (e - s).astype(np.uint64))
