"""Hashes of byte runs and of windows of them, computed for whole arrays at once.

A run of bytes is hashed by a polynomial modulo the prime 2^61 - 1, taken from prefix sums: the hash
is the difference of two prefix sums times a power of the inverse base. (Modulo 2^64 there are texts
that collide whatever the base.) A window of such hashes, at most ``MOST_ITEMS`` of them, is hashed
modulo 2^64; texts that collide there need more items. A final mix spreads the bits.
"""

from __future__ import annotations

import numpy as np

SPAN = 1 << 20
PIECE = 1 << 16  # bytes between two starts of the prefix sums, so that these stay below 2^64
MOST_ITEMS = 511
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd; one for each of two independent hashes
PRIME = (1 << 61) - 1
_P, _LOW32, _LOW29 = np.uint64(PRIME), np.uint64(0xFFFFFFFF), np.uint64((1 << 29) - 1)
_29, _32, _61 = np.uint64(29), np.uint64(32), np.uint64(61)


def mix(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64: a bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    """Numbers below 2^64 modulo 2^61 - 1."""
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def _joined(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """high * 2^32 + low modulo 2^61 - 1, for high below 2^61."""
    return _reduced((high >> _29) + ((high & _LOW29) << _32) + (low >> _61) + (low & _P))


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2^61 - 1 of numbers below it."""
    al, ah, bl, bh = a & _LOW32, a >> _32, b & _LOW32, b >> _32
    middle = al * bh + ah * bl
    return _reduced(_joined(middle, al * bl) + ((ah * bh) << np.uint64(3)))  # 2^64 is 8


def _power_table(base: int, n: int) -> np.ndarray:
    table = np.ones(n, np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        table[done : done + more] = times(table[:more], np.uint64(pow(base, done, PRIME)))
        done += more
    return table


class Hasher:
    """One of the hash functions, with its tables of powers. Made inside a task, not sent to it."""

    def __init__(self, which: int = 0):
        self.base = BASES[which]
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)
        self.prime_base = self.base % PRIME
        self.low = self.high = self.back = None

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", self.base), ("down", self.inverse)):
                table = np.full(max(n, SPAN), base, np.uint64)
                table[0] = 1
                setattr(self, name, np.multiply.accumulate(table))
        return self.up[:n], self.down

    def runs(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hash of each ``data[start:end]``; runs are ascending and apart. Works piece by piece."""
        if self.low is None:
            up = _power_table(self.prime_base, PIECE)
            self.low, self.high = up & _LOW32, up >> _32
            self.back = _power_table(pow(self.prime_base, -1, PRIME), PIECE + 1)
        out = np.empty(len(starts), np.uint64)
        at = 0
        while at < len(starts):
            lo = starts[at]
            to = int(np.searchsorted(ends, lo + PIECE, "right"))
            if to <= at:  # a longer run alone
                out[at] = self._long(data[lo : ends[at]])
                at += 1
                continue
            low, high = self._sums(data[lo : ends[to - 1]])
            s, e = starts[at:to] - lo, ends[at:to] - lo
            out[at:to] = times(_joined(high[e] - high[s], low[e] - low[s]), self.back[s])
            at = to
        return mix(out ^ mix((ends - starts).astype(np.uint64)))

    def _sums(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Prefix sums of bytes times powers, apart for the lower and the upper half of the powers."""
        part = data.astype(np.uint64) + np.uint64(1)
        low, high = np.zeros(len(part) + 1, np.uint64), np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * self.low[: len(part)], out=low[1:])
        np.cumsum(part * self.high[: len(part)], out=high[1:])
        return low, high

    def _long(self, data: np.ndarray) -> int:
        total, step, power = 0, pow(self.prime_base, PIECE, PRIME), 1
        for at in range(0, len(data), PIECE):
            low, high = self._sums(data[at : at + PIECE])
            total = (total + ((int(high[-1]) << 32) + int(low[-1])) * power) % PRIME
            power = power * step % PRIME
        return total

    def windows(self, hashes: np.ndarray, size: int) -> np.ndarray:
        """The hash of every ``size`` consecutive items: n - size + 1 of them, none if n < size."""
        if size > MOST_ITEMS:
            raise ValueError(f"a window holds at most {MOST_ITEMS} items")
        n = len(hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.empty(n, np.uint64)
        for at in range(0, n, SPAN):
            part = hashes[at : at + SPAN + size - 1]
            up, down = self._powers(len(part))
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * up, out=sums[1:])
            k = len(part) - size + 1
            out[at : at + k] = (sums[size:] - sums[:-size]) * down[:k]
        return mix(out)
