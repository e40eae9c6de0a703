"""Character n-grams of whole texts as packed 64-bit integers (numpy)."""

from __future__ import annotations

import numpy as np

# A character takes 12 bits: code points below 2048 as they are, the others folded into the upper half.
BITS = 12
_HALF = 1 << (BITS - 1)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def small_codes(cp: np.ndarray) -> np.ndarray:
    """Code points as 12-bit symbols."""
    return np.where(cp < _HALF, cp, _HALF + (cp * np.uint32(0x9E3779B1) >> np.uint32(32 - (BITS - 1)))).astype(np.uint64)


def packed(codes: np.ndarray, n: int) -> np.ndarray:
    """The n-grams of a symbol sequence, n <= 5, tagged with their length."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = codes[:m].copy()
    for i in range(1, n):
        out <<= np.uint64(BITS)
        out |= codes[i:i + m]
    return out | np.uint64(n) << np.uint64(61)


def hashed(codes: np.ndarray, n: int) -> np.ndarray:
    """The n-grams of a symbol sequence for n > 5, as 64-bit hashes."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = packed(codes, 5)[:m]
    for i in range(5, n):
        out = (out ^ codes[i:i + m]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _table(test) -> np.ndarray:
    """Truth table of a character test over the basic plane."""
    return np.fromiter((test(chr(i)) for i in range(0x10000)), bool, 0x10000)


class Alphabet:
    """Character classes, built once per worker."""

    _letters: np.ndarray | None = None
    _blank: np.ndarray | None = None

    @classmethod
    def letters(cls, cp: np.ndarray) -> np.ndarray:
        if cls._letters is None:
            cls._letters = _table(str.isalpha)
        low = np.minimum(cp, 0xFFFF)
        is_letter = cls._letters[low]
        high = cp > 0xFFFF
        if high.any():
            is_letter = is_letter.copy()
            is_letter[high] = [chr(c).isalpha() for c in cp[high]]
        return is_letter

    @classmethod
    def blanks(cls, cp: np.ndarray) -> np.ndarray:
        if cls._blank is None:
            cls._blank = _table(str.isspace)
        return cls._blank[np.minimum(cp, 0xFFFF)]


def squeeze(cp: np.ndarray, blank: np.ndarray) -> np.ndarray:
    """Symbols with every run of blank positions as one space, and one at both ends."""
    padded = np.empty(len(cp) + 2, np.uint64)
    padded[0] = padded[-1] = 32
    padded[1:-1] = small_codes(cp)
    padded[1:-1][blank] = 32
    gap = padded == 32
    keep = np.ones(len(padded), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    return padded[keep]
