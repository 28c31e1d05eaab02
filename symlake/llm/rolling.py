"""Vectorised polynomial fingerprints of byte strings.

``Prints`` choose, route and prefilter; they have collisions that anyone can make, so nothing is taken to be equal by
them. With prefix sums H[i] = sum of (c_j + 1) * B^j for j < i, modulo 2^64 and B odd, the value
(H[e] - H[s]) * B^-s depends on the bytes s..e alone. Any substring's fingerprint so takes two lookups.
"""

from __future__ import annotations

import secrets
from functools import lru_cache

import numpy as np

BASE = 0x9E3779B97F4A7C15
U64 = np.uint64


@lru_cache(maxsize=1)
def _tables(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = (1 << bits) + 1
    up, down = np.full(n, U64(BASE)), np.full(n, U64(pow(BASE, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of B and of its inverse for buffers of up to size bytes."""
    return _tables(max(20, int(size).bit_length()))


class Prints:
    """Fingerprints of substrings of one buffer."""

    def __init__(self, buf: np.ndarray) -> None:
        n = len(buf)
        up, self.down = tables(n)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum((buf.astype(U64) + U64(1)) * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def grams(self, k: int) -> np.ndarray:
        """Of all k-byte strings, by start."""
        m = max(0, len(self.sums) - k)
        return (self.sums[k : k + m] - self.sums[:m]) * self.down[:m]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble (the finaliser of splitmix64), so that the high bits depend on all bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


# Prints that names are made of: polynomials modulo a prime at a base that is drawn for each run. For any two different
# strings of n symbols, whoever made them, at most n of the 2^61 bases give equal prints.
PRIME = (1 << 61) - 1
_P, _LOW = U64(PRIME), U64((1 << 31) - 1)
_BLOCK = 1 << 23


def drawn_base() -> int:
    return secrets.randbelow(PRIME - (1 << 32)) + (1 << 31)


def _fold(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> U64(61))
    return np.where(x >= _P, x - _P, x)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of residues, by halves of 31 bits, as 2^61 is 1."""
    ah, al, bh, bl = a >> U64(31), a & _LOW, b >> U64(31), b & _LOW
    mid = al * bh + ah * bl
    return _fold(ah * bh * U64(2) + (mid >> U64(30)) + ((mid & U64((1 << 30) - 1)) << U64(31)) + al * bl)


@lru_cache(maxsize=3)
def _powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Low and high parts of the powers of a base, and the powers of its inverse."""
    n = (1 << bits) + 1
    out = []
    for b in (base, pow(base, -1, PRIME)):
        x, size = np.ones(n, U64), 1
        while size < n:
            m = min(size, n - size)
            x[size : size + m] = product(x[:m], np.array(pow(b, size, PRIME), U64))
            size += m
        out.append(x)
    return out[0] & _LOW, out[0] >> U64(31), out[1]


class PrimePrints:
    """Prints of substrings of one buffer of bytes or 64-bit symbols."""

    def __init__(self, buf: np.ndarray, base: int) -> None:
        n = len(buf)
        low, high, self.down = _powers(base, max(20, n.bit_length()))
        if buf.dtype == np.uint8:
            c = buf.astype(U64) + U64(1)
            parts = c * low[:n], c * high[:n]
        else:
            t = product(_fold(buf.astype(U64)), high[:n] << U64(31) | low[:n])
            parts = t & _LOW, t >> U64(31)
        self.sums = tuple(self._summed(x) for x in parts)

    @staticmethod
    def _summed(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x) + 1, U64)
        for at in range(0, len(x), _BLOCK):  # a block's sum and what is carried fit into 64 bits
            part = out[at + 1 : at + 1 + _BLOCK]
            np.cumsum(x[at : at + _BLOCK], out=part)
            part += _fold(out[at : at + 1])
        return out

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        low, high = (_fold(_fold(s[end]) + _P - _fold(s[start])) for s in self.sums)
        return product(_fold(product(high, np.array(1 << 31, U64)) + low), self.down[start])
