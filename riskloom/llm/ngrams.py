"""Hashed character n-grams of UTF-8 texts, as arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import textcore as C

_MULTIPLIERS = np.random.default_rng(0xC0FFEE).integers(1, 2**62, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: ASCII letters in lower case, all bytes beyond ASCII as they are, everything else a space
_LETTERS = np.where((C.LOWER >= 0x61) & (C.LOWER <= 0x7A) | (C.LOWER >= 0x80), C.LOWER, 0x20).astype(np.uint8)


def letters_only(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a space before each, in lower case (ASCII and Latin-1 letters), runs of non-letters as one space.

    Bytes and n + 1 bounds; a text without letters is one space.
    """
    data, offsets = C.string_bytes(column)
    n = len(offsets) - 1
    flat = np.insert(_LETTERS[data], offsets[:-1], 0x20)
    bounds = offsets + np.arange(n + 1)
    if len(flat) > 1:
        upper = np.flatnonzero((flat[:-1] == 0xC3) & (flat[1:] >= 0x80) & (flat[1:] <= 0x9E) & (flat[1:] != 0x97)) + 1
        flat[upper] += 0x20
    keep = np.ones(len(flat), bool)
    keep[1:] = (flat[1:] != 0x20) | (flat[:-1] != 0x20)
    keep[bounds[:-1]] = True
    return flat[keep], np.append(0, np.cumsum(keep))[bounds]


def code_points(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One number for each code point (its bytes), and n + 1 bounds."""
    begins = (flat & 0xC0) != 0x80
    begins[bounds[:-1][np.diff(bounds) > 0]] = True
    at = np.flatnonzero(begins)
    sizes = np.diff(np.append(at, len(flat)))
    out = flat[at].astype(np.int64)
    for k in range(1, 4):
        more = sizes > k
        out[more] |= flat[at[more] + k].astype(np.int64) << 8 * k
    return out, np.append(0, np.cumsum(begins))[bounds]


def buckets(flat: np.ndarray, bounds: np.ndarray, width: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram at each position where one lies in its text, and the text of each."""
    n = len(flat) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h += flat[k : k + n].astype(np.uint64) * _MULTIPLIERS[k]
    h ^= h >> np.uint64(29)
    h *= _MULTIPLIERS[15]
    sizes = np.diff(bounds)
    text = np.repeat(np.arange(len(sizes)), sizes)[:n]
    inside = np.arange(n) + width <= bounds[1:][text]
    return (h >> np.uint64(64 - bits)).astype(np.int64)[inside], text[inside]
