"""Vectorised tokenising and hashing of UTF-8 text with numpy.

All hashes are 64-bit. A word's hash is a polynomial modulo the prime 2**61 - 1
over a random value for each byte, so any range of bytes is hashed from two
prefix sums, and no pattern of bytes collides whatever the base is, as some do
modulo a power of two; ``mix`` then spreads the bits.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_PRIME = (1 << 61) - 1
_ROOT = _BASE % _PRIME
_P, _LOW = np.uint64(_PRIME), np.uint64((1 << 31) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator, for uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2**61 - 1 of uint64 values below it, by halves of 31 bits."""
    shift = np.uint64(31)
    ah, al, bh, bl = a >> shift, a & _LOW, b >> shift, b & _LOW
    mid = ah * bl + al * bh
    return _reduced(((ah * bh) << np.uint64(1)) + (mid >> np.uint64(30)) + ((mid & np.uint64((1 << 30) - 1)) << shift) + al * bl)


class _Powers:
    """Powers of a number modulo the prime, as far as they were asked for."""

    def __init__(self, root: int):
        self.root, self.known = root, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.known) < n:
            step = np.uint64(pow(self.root, len(self.known), _PRIME))
            self.known = np.concatenate((self.known, times(self.known, step)))
        return self.known[:n]


_POWERS, _INVERSES = _Powers(_ROOT), _Powers(pow(_ROOT, -1, _PRIME))


def _stream(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed))


def lower_table() -> np.ndarray:
    """Byte table that lower-cases A-Z only."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def class_table(separators) -> np.ndarray:
    """True for every byte that is not in ``separators``."""
    t = np.ones(256, bool)
    t[list(separators)] = False
    return t


#: Separators of the contracts' two kinds of words; A-Z count as the lower-case letters they become.
SPACE_SEPARATORS = [0x20, *range(0x09, 0x0E)]
SYMBOL_SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` bytes, by a polynomial modulo 2**64; ``width`` is short, as patterns that such a one confuses take 1,024 bytes and more."""
    n = len(data)
    if n < width:
        return np.zeros(0, np.uint64)
    powers, inverse = np.full(n, _BASE, np.uint64), np.full(n - width + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    powers[0] = inverse[0] = 1
    np.multiply.accumulate(powers, out=powers)
    np.multiply.accumulate(inverse, out=inverse)
    powers *= _stream(256, 7)[data]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(powers, out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * inverse)


class RangeHasher:
    """Hashes of arbitrary byte ranges of one buffer.

    ``table`` maps each byte before hashing (lower-casing, for example).
    """

    def __init__(self, data: np.ndarray, table: np.ndarray | None = None, seed: int = 7):
        values = _reduced(_stream(256, seed))
        if table is not None:
            values = values[table]
        n = len(data)
        self._inverse = _INVERSES.upto(n + 1)
        terms = times(_POWERS.upto(n), values[data])
        sums = [np.cumsum(part, dtype=np.uint64) for part in (terms >> np.uint64(31), terms & _LOW)]  # halves don't overflow
        self._sums = np.zeros(n + 1, np.uint64)
        high = _reduced(sums[0])  # times 2**31, which turns the 61 bits round
        self._sums[1:] = _reduced((((high << np.uint64(31)) & _P) | (high >> np.uint64(30))) + _reduced(sums[1]))

    def __call__(self, start, end) -> np.ndarray:
        """Hash of each [start, end); equal bytes give equal hashes wherever they stand."""
        size = np.asarray(end - start).astype(np.uint64)
        value = times(_reduced(self._sums[end] + _P - self._sums[start]), self._inverse[start])
        return mix(value + size * np.uint64(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and each row's range in those arrays (n + 1 bounds)."""
    inside = is_word[data]
    first, last = inside.copy(), inside.copy()
    if len(data) > 1:
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
    begins, ends = offsets[:-1], offsets[1:]
    full = ends > begins
    first[begins[full]] = inside[begins[full]]
    last[ends[full] - 1] = inside[ends[full] - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive word hashes (row bounds are the caller's affair)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(_BASE) + words[k : k + n])
    return out
