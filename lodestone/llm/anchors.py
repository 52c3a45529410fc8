"""Sampled suffixes of texts: where they start is told by the bytes around alone, so equal passages are sampled alike.

Each window of LENGTH bytes has one anchor: the start of its GRAM-byte string of least hash (the leftmost of equal
ones). Neighbouring windows with one anchor make a block. A suffix array over the anchors (a sparse suffix array) holds
a tenth of a thousandth part or so of what one over all bytes would, and misses no repeat of LENGTH bytes, because both
places have the same anchor at the same offset.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LENGTH, GRAM = 200, 64
#: An odd base, invertible modulo 2**64, and the multipliers of the final mix.
BASE = 0x9E3779B97F4A7C15
MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
S33 = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> S33)) * MIX[0]
    x = (x ^ (x >> S33)) * MIX[1]
    return x ^ (x >> S33)


class Hashes:
    """Hashes of any substrings of a buffer, from prefix sums of byte * BASE**position modulo 2**64."""

    _powers = np.ones(1, dtype=np.uint64)
    _inverse = np.ones(1, dtype=np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(Hashes._powers) < n + 1:
            size = 1 << (n + 1).bit_length()
            for name, base in (("_powers", BASE), ("_inverse", pow(BASE, -1, 1 << 64))):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(Hashes, name, np.cumprod(steps, dtype=np.uint64))
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * Hashes._powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * Hashes._inverse[start] + mix((end - start).astype(np.uint64)))

    def grams(self, n: int) -> np.ndarray:
        """Of all strings of n bytes."""
        m = len(self.sums) - n
        return mix((self.sums[n:] - self.sums[:m]) * Hashes._inverse[:m])


def least(keys: np.ndarray, n: int) -> np.ndarray:
    """The least of each n keys in a row."""
    span, out = 1, keys
    while span * 2 <= n:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(keys) - n + 1], out[n - span : n - span + len(keys) - n + 1]) if span < n else out


def blocks(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[Hashes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, start, count, anchor hash, anchor): the blocks of texts that stand one after another up to ends.

    start: the first byte of a block's first window; count: its windows, which start at as many bytes in a row.
    """
    h = Hashes(data)
    n = len(data)
    none = np.zeros(0, dtype=np.int64)
    if n < length:
        return h, none, none, none.astype(np.uint64), none
    found, bits = h.grams(gram), np.uint64(int(n).bit_length())
    keys = ((found >> bits) << bits) | np.arange(len(found), dtype=np.uint64)
    anchor = (least(keys, length - gram + 1) & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    starts = np.arange(len(anchor))
    text = np.searchsorted(ends, starts, side="right")
    inside = starts + length <= ends[np.minimum(text, len(ends) - 1)]
    starts, anchor, text = starts[inside], anchor[inside], text[inside]
    if not len(starts):
        return h, none, none, none.astype(np.uint64), none
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    count = np.diff(np.concatenate([first, [len(starts)]]))
    return h, starts[first], count, found[anchor[first]], anchor[first]


def segments(texts: list[bytes], most: int, length: int = LENGTH) -> Iterator[tuple[int, int, bytes]]:
    """(text, first byte, bytes): texts of more than most windows in parts that share length - 1 bytes."""
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), most):
            yield k, at, t[at : at + most + length - 1]
