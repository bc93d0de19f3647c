"""md5 of many short texts at a time in numpy: the draws of :mod:`riskloom.functions.hashing` inside Python tasks.

A text of up to 55 bytes is one block of md5, whose 64 steps are the same for all texts; so a step is a
few operations on whole arrays. Longer texts go through hashlib.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

_ADD = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_TURN = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Texts hashed at a time, few enough for a core's cache.
_SOME = 16384


def _first_words(words: list[np.ndarray | int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the digests of n blocks, each word of which is an array or one number for all."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            g = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        word = words[g]
        if isinstance(word, int):
            f += np.uint32((_ADD[i] + word) & 0xFFFFFFFF)
        else:
            f += np.uint32(_ADD[i])
            f += word
        turn = _TURN[i // 16][i % 4]
        np.left_shift(f, np.uint32(turn), out=t)
        f >>= np.uint32(32 - turn)
        f |= t
        np.add(b, f, out=a)
        a, b, c, d = d, a, b, c
    a += np.uint32(_START[0])
    b += np.uint32(_START[1])
    return a, b


class Texts:
    """Texts that are hashed behind many prefixes."""

    def __init__(self, texts: Sequence[bytes]):
        self.texts = texts
        sizes = np.array([len(x) for x in texts], np.int64)
        self.groups: list[tuple[np.ndarray, np.ndarray]] = []
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            for i in range(0, len(at), _SOME):
                some = at[i : i + _SOME]
                self.groups.append((some, np.frombuffer(b"".join(texts[j] for j in some), np.uint8).reshape(len(some), size)))
        self.blocks: dict[tuple[int, int], list[np.ndarray | int]] = {}

    def _block(self, k: int, before: int) -> list[np.ndarray | int]:
        """The block's words with `before` bytes left free for a prefix."""
        if (k, before) not in self.blocks:
            _, own = self.groups[k]
            size = own.shape[1]
            block = np.zeros((len(own), 64), np.uint8)
            block[:, before : before + size] = own
            block[:, before + size] = 0x80
            first, last = before // 4, (before + size) // 4
            words: list[np.ndarray | int] = [0] * 16
            for w in range(first, last + 1):
                words[w] = np.ascontiguousarray(block[:, 4 * w : 4 * w + 4]).view("<u4").ravel().astype(np.uint32)
            words[14] = 8 * (before + size)
            self.blocks[k, before] = words
        return self.blocks[k, before]

    def first8(self, prefix: bytes) -> np.ndarray:
        """The first 8 bytes of md5(prefix + text) of each text as a number whose order is that of the digests' hex."""
        out = np.empty(len(self.texts), np.uint64)
        padded = prefix + b"\0" * (-len(prefix) % 4)
        fixed = [int.from_bytes(padded[i : i + 4], "little") for i in range(0, len(padded), 4)]
        for k, (at, own) in enumerate(self.groups):
            if len(prefix) + own.shape[1] > 55:
                out[at] = [int.from_bytes(hashlib.md5(prefix + self.texts[j]).digest()[:8], "big") for j in at]
                continue
            words = list(self._block(k, len(prefix)))
            for w, x in enumerate(fixed):
                words[w] = words[w] | x if isinstance(words[w], int) else words[w] | np.uint32(x)
            a, b = _first_words(words, len(at))
            out[at] = a.byteswap().astype(np.uint64) << np.uint64(32) | b.byteswap()
        return out


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 2 * _SOME) -> Iterator[pa.RecordBatch]:
    """The batches, in their order, united to `rows` rows and more: a step of many hashes costs little more than one of few."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)
