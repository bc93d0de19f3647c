"""Vectorised word splitting and hashing over Arrow string columns.

A word is a maximal run of bytes of one byte class; both classes below only
exclude ASCII characters, so splitting UTF-8 bytes equals splitting code points.
Hashes are 64-bit polynomial hashes with per-byte random values, mixed with the
word's length. They are the same on every machine and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_RNG = np.random.default_rng(0x5EED)
_BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_GRAM_INV = np.uint64(pow(int(_GRAM), -1, 1 << 64))

SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: bytes of `[^\x20\x09-\x0D]+`
NON_SPACE = ~SPACES
#: bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (digits, a-z, everything beyond ASCII)
ALNUM_LOWER = np.zeros(256, bool)
ALNUM_LOWER[0x30:0x3A] = True
ALNUM_LOWER[0x61:0x7B] = True
ALNUM_LOWER[0x80:] = True
#: A-Z to a-z, other bytes as they are
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n + 1, base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


_POW = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0..n modulo 2**64; the table of up to CHUNK entries is kept."""
    if n > CHUNK:
        return _powers(base, n)
    if base not in _POW:
        _POW[base] = _powers(base, CHUNK)
    return _POW[base]


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the n + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Row slices of about `most` bytes of `column`; a longer text is a slice of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    total = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
    at, n = 0, batch.num_rows
    while at < n:
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + most, "right")))
        yield batch.slice(at, end - at)
        at = end


class Words:
    """The words of some texts: byte positions, hashes, and first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, hashed: bool = True):
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = is_word[data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        self.starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
        self.ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = self._hash() if hashed else None

    def _hash(self) -> np.ndarray:
        out = np.empty(len(self.starts), np.uint64)
        i, n = 0, len(self.starts)
        while i < n:
            a = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, a + CHUNK, "right")))
            size = int(self.ends[j - 1] - a)
            total = np.zeros(size + 1, np.uint64)
            np.cumsum(_BYTE_VALUE[self.data[a : a + size]] * powers(_BASE, size)[:size], out=total[1:])
            s, e = self.starts[i:j] - a, self.ends[i:j] - a
            h = (total[e] - total[s]) * powers(_BASE_INV, size)[s]
            out[i:j] = mix(h + (e - s).astype(np.uint64))
            i = j
        return out

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def inside(self, width: int) -> np.ndarray:
        """Whether `width` words from each word on lie in one text."""
        last = np.repeat(self.first[1:], self.counts())
        return np.arange(len(self)) + width <= last


def grams(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hashes of `width` consecutive words from each word on, len - width + 1 of them (or none)."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64)
    out = np.empty(n - width + 1, np.uint64)
    for a in range(0, len(out), CHUNK // 2):
        b = min(len(out), a + CHUNK // 2)
        part = hashes[a : b + width - 1]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * powers(_GRAM, len(part))[: len(part)], out=total[1:])
        out[a:b] = (total[width:] - total[:-width]) * powers(_GRAM_INV, len(part))[: b - a]
    return mix(out + np.uint64(width) + np.uint64(seed))


def folded(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return LOWER[data]


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, and n + 1 bounds."""
    data, offsets = string_bytes(column)
    words = Words(folded(data), offsets, NON_SPACE)
    counts = words.counts()
    n_texts, n = len(counts), len(words)
    text = np.repeat(np.arange(n_texts), counts)
    full = words.inside(width)
    at = np.flatnonzero(full)
    hashes, owners = grams(words.hashes, width, 7)[at], text[at]
    few = np.flatnonzero((counts > 0) & (counts < width))
    if len(few):
        own = [int(grams(words.hashes[words.first[i] : words.first[i + 1]], int(counts[i]), 8)[0]) for i in few]
        hashes, owners = np.concatenate([hashes, np.array(own, np.uint64)]), np.concatenate([owners, few])
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    hashes, owners = hashes[new], owners[new]
    return hashes, np.searchsorted(owners, np.arange(n_texts + 1))
