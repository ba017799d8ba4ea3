"""Hashes of all substrings of a text, as arrays."""

from __future__ import annotations

import numpy as np

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any substring from prefix sums of byte value times base to the power of the position."""

    powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, base: int):
        self.base = base
        self.values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        known = self.powers.get(self.base)
        if known is None or len(known[0]) < n:
            size = 1 << max(16, n.bit_length())
            with np.errstate(over="ignore"):
                pair = []
                for b in (self.base, pow(self.base, -1, 1 << 64)):
                    steps = np.full(size, b, np.uint64)
                    steps[0] = 1
                    pair.append(np.multiply.accumulate(steps))
            known = self.powers[self.base] = tuple(pair)
        return known

    def prefixes(self, data: np.ndarray) -> np.ndarray:
        up, _ = self._powers(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * up[: len(data)], out=out[1:])
        return out

    def of(self, prefixes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        _, down = self._powers(len(prefixes))
        return mixed((prefixes[stop] - prefixes[start]) * down[start])

    def all_of(self, prefixes: np.ndarray, size: int) -> np.ndarray:
        _, down = self._powers(len(prefixes))
        return mixed((prefixes[size:] - prefixes[:-size]) * down[: len(prefixes) - size])


FIRST, SECOND = (Rolling(b) for b in BASES)
