"""Word-level numpy kernels shared by the operators of this subpackage.

A text is handled as UTF-8 bytes.  A word is a maximal run of bytes other than
ASCII white space; A-Z are lower-cased.  Hashes of word runs are polynomial
prefix differences modulo 2**64, so that a window of any length costs O(1).
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            with np.errstate(over="ignore"):
                up = np.full(size, _BASE, np.uint64)
                down = np.full(size, _INV, np.uint64)
                up[0] = down[0] = 1
                self.up = np.multiply.accumulate(up)
                self.down = np.multiply.accumulate(down)
        return self.up[:n], self.down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(data: bytes, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end byte, hash) of each word of lower-cased UTF-8 bytes."""
    raw = np.frombuffer(data, np.uint8)
    inside = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate((np.zeros(1, np.int8), inside.view(np.int8), np.zeros(1, np.int8)))))
    starts, ends = edge[0::2], edge[1::2]
    up, down = powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64, out=sums[1:])
        return starts, ends, mix((sums[ends] - sums[starts]) * down[starts])


def prefix(hashes: np.ndarray, powers: Powers) -> np.ndarray:
    up, _ = powers(len(hashes))
    with np.errstate(over="ignore"):
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up, dtype=np.uint64)))


def window_hashes(sums: np.ndarray, starts: np.ndarray, length: int, powers: Powers) -> np.ndarray:
    """Hash of the run of `length` words at each start; equal runs hash alike in every text."""
    _, down = powers(len(sums))
    with np.errstate(over="ignore"):
        return mix((sums[starts + length] - sums[starts]) * down[starts])


def sliding(x: np.ndarray, window: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each run of `window` entries, by doubling."""
    have = 1
    while 2 * have <= window:
        x = pick(x[:-have], x[have:])
        have *= 2
    rest = window - have
    return pick(x[: len(x) - rest], x[rest:]) if rest else x
