"""64-bit hashes of many short runs of numbers at once."""

from __future__ import annotations

import numpy as np

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_multipliers = mix(np.arange(1, 257, dtype=np.uint64) * _GOLDEN) | np.uint64(1)


def multipliers(n: int) -> np.ndarray:
    """One odd multiplier per place in a run."""
    global _multipliers
    if n > len(_multipliers):
        _multipliers = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * _GOLDEN) | np.uint64(1)
    return _multipliers


def hash_runs(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The hash of each run; ``values`` holds the runs one after the other, none empty."""
    if not len(lengths):
        return np.empty(0, np.uint64)
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(values)) - np.repeat(first, lengths)
    odd = multipliers(int(lengths.max()))
    return mix(np.add.reduceat((values.astype(np.uint64) + np.uint64(1)) * odd[place], first))


def hash_pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _GOLDEN + (right ^ (right >> np.uint64(29))))
