"""Tokens of many texts at once, as numpy arrays over their joined bytes."""

from __future__ import annotations

import numpy as np

U = np.uint64
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: All but ASCII letters, digits and bytes of longer characters part tokens.
OTHER = np.ones(256, bool)
OTHER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


_CODES = mix(np.arange(1, 257, dtype=U))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, n of them at least."""
    if len(_powers[0]) < n:
        n = max(n, 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.full(n, base, U)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


class Tokens:
    """Tokens of the rows of ``data`` cut at ``offsets``: start, end, row, and hashes of any byte range."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, parts: np.ndarray = BLANK, latin: bool = False) -> None:
        n = len(data)
        low = LOWER[data]
        if latin and n > 1:  # capital letters of the Latin-1 block, two bytes each in UTF-8
            lead = np.flatnonzero(low[:-1] == 0xC3) + 1
            lead = lead[(low[lead] >= 0x80) & (low[lead] <= 0x9E) & (low[lead] != 0x97)]
            low[lead] += 0x20
        inside = ~parts[low]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        begins = offsets[:-1][offsets[:-1] < n]
        first[begins] = inside[begins]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        ends = offsets[1:][offsets[1:] > 0] - 1
        last[ends] = inside[ends]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        self.rows, self.low = len(offsets) - 1, low
        up, self._down = powers(n + 1)
        self._sums = np.zeros(n + 1, U)
        np.cumsum(_CODES[low] * up[:n], out=self._sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._down[start] + (end - start).astype(U))

    def words(self) -> np.ndarray:
        return self.hashes(self.start, self.end)

    def per_row(self) -> np.ndarray:
        """Tokens in each row."""
        return np.bincount(self.row, minlength=self.rows)
