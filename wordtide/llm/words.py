"""Words of texts as byte spans and hashes, for operators that take whole texts apart in array operations."""

from __future__ import annotations

import numpy as np

from .common import SPAN, U64, mix64, span_hashes

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def table(of: bytes) -> np.ndarray:
    """A flag for each byte value, set for those of `of`."""
    out = np.zeros(256, dtype=bool)
    out[list(of)] = True
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, ascending, of the maximal runs of bytes without apart[byte]; no run crosses the end of a text."""
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    word = ~apart[data]
    head = np.zeros(len(data) + 1, dtype=bool)
    head[offsets] = True
    start, end = word.copy(), word
    start[1:] &= ~word[:-1] | head[1:-1]
    end = word.copy()
    end[:-1] &= ~word[1:] | head[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def lowered_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans with A-Z lower-cased; SPAN bytes are hashed at once."""
    return span_hashes(lambda a, b: _BYTE[LOWER[data[a:b]]], len(data), starts, ends) if len(starts) else np.zeros(0, dtype=U64)


def window_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n bytes from each byte on, as many as there are; data of SPAN bytes at most."""
    if len(data) < n or len(data) > SPAN + n:
        return np.zeros(0, dtype=U64)
    at = np.arange(len(data) - n + 1)
    return span_hashes(lambda a, b: _BYTE[data[a:b]], len(data), at, at + n)


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """Order of rows by columns of unsigned 64-bit numbers, the first most significant: a radix sort by digits of 16 bits, least
    significant first, which numpy's stable sort of such digits is. Digits that all rows share are left out."""
    order = np.arange(len(columns[0]))
    for c in reversed(columns):
        varies = int(np.bitwise_or.reduce(c ^ c[0])) if len(c) else 0
        for shift in range(0, 64, 16):
            if varies >> shift & 0xFFFF:
                digit = (c >> U64(shift)).astype(np.uint16)
                order = order[np.argsort(digit[order], kind="stable")]
    return order
