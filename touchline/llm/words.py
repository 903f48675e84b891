"""Words as numbers: 128-bit digests of words and rolling hashes of word sequences, in numpy.

A word is a maximal run of bytes other than space, tab and the other ASCII line and page breaks; its
digest is XXH3-128, read as two independent 64-bit numbers.  The hash of a sequence is polynomial
modulo 2^64 over one of the two numbers, so every sequence of a document costs three array
operations.  Both hashes together serve as the identity of a sequence.
"""
from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers of the two polynomial hashes (arbitrary) and their inverses modulo 2^64.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS = [np.ones(1, np.uint64)] * 4


def numbers(words: list[bytes]) -> np.ndarray:
    """Two 64-bit numbers for each word: an array of shape (2, n)."""
    flat = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64)
    return np.ascontiguousarray(flat.reshape(-1, 2).T)


def powers(n: int, which: int, inverse: bool) -> np.ndarray:
    """M^0 ... M^(n-1) modulo 2^64, or those of its inverse."""
    slot = which * 2 + inverse
    if len(_POWERS[slot]) < n:
        m = MULTIPLIERS[which]
        base = pow(m, -1, 1 << 64) if inverse else m
        steps = np.full(1 << (n - 1).bit_length(), base, np.uint64)
        steps[0] = 1
        _POWERS[slot] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[slot][:n]


class Rolling:
    """Hashes of the word sequences of one document under one of the two polynomials."""

    def __init__(self, x: np.ndarray, which: int):
        self.which = which
        self.sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * powers(len(x), which, False), dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        """Hash of the ``length`` words from ``start`` on."""
        value = self.sums[start + length] - self.sums[start]
        n = len(self.sums)
        return value * powers(n, self.which, True)[start] * np.uint64(MULTIPLIERS[0]) + np.asarray(length).astype(np.uint64)
