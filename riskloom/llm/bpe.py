"""Byte-level BPE: encoding and decoding.

Pre-tokenisation works on arrays of code point classes. Each class is a function
on the states of the automaton of the public pattern; functions compose
associatively, so the states at all positions come from a blocked prefix scan
over a table of compositions, without a regular expression. The slices between
boundaries are merged once each, all new ones at a time, and kept in a cache.

Null and empty texts give no tokens. Extra columns pass through unchanged; names
of the columns made here (token_ids, token_starts) replace columns of that name.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textcore as C

# ---- automaton -------------------------------------------------------------------------------------------------------
# classes: letter, number, other, apostrophe of a contraction with one or two letters,
# white space within a run, a run's last space before a token, its last other white space before a token
LETTER, NUMBER, OTHER, SHORT, LONG, WHITE, SPACE_LAST, WHITE_LAST = range(8)
# states: fresh, in letters, in numbers, in others, after a space that opens a token, in white space,
# two or one letters of a contraction to come
FRESH, IN_L, IN_N, IN_O, OPEN, IN_W, TWO, ONE = range(8)
STATES = 8


def _step(state: int, kind: int) -> tuple[int, bool]:
    """Next state, and whether the character starts a token."""
    if state == TWO:
        return ONE, False
    if state == ONE:
        return FRESH, False
    if kind in (LETTER, NUMBER, OTHER):
        run = (IN_L, IN_N, IN_O)[kind]
        return run, state not in (run, OPEN)
    if kind in (SHORT, LONG):
        return (IN_O, False) if state in (IN_O, OPEN) else (ONE if kind == SHORT else TWO, True)
    if kind == WHITE:
        return IN_W, state != IN_W
    return (OPEN if kind == SPACE_LAST else FRESH), True


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Function of each class (the second eight start a text), compositions, applications, boundaries."""
    plain = [tuple(_step(s, k)[0] for s in range(STATES)) for k in range(8)]
    reset = [(f[FRESH],) * STATES for f in plain]
    known = {tuple(range(STATES)): 0}
    for f in plain + reset:
        known.setdefault(f, len(known))
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in plain + reset:
            if (h := tuple(g[s] for s in f)) not in known:
                known[h] = len(known)
                todo.append(h)
    functions = np.array(list(known), np.uint8)
    compose = np.empty((len(known), len(known)), np.uint16)
    for h, i in known.items():
        for g, j in known.items():
            compose[i, j] = known[tuple(g[s] for s in h)]
    of_class = np.array([known[f] for f in plain + reset], np.uint16)
    starts = np.array([[_step(s, k)[1] for k in range(8)] for s in range(STATES)])
    return of_class, compose, functions, starts


WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind in "LN":
            table[cp] = LETTER if kind == "L" else NUMBER
    table[WHITE_SPACE] = WHITE
    return table


def states_before(functions: np.ndarray, width: int = 64) -> np.ndarray:
    """The state before each position, by a prefix scan over compositions of transition functions."""
    _, compose, apply, _ = _tables()
    n = len(functions)
    rows = -(-n // width)
    grid = np.zeros(rows * width, np.uint16)
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    for t in range(1, width):
        grid[t] = compose[grid[t - 1], grid[t]]
    block, shift = grid[-1].copy(), 1
    while shift < rows:
        block[shift:] = compose[block[:-shift], block[shift:]]
        shift *= 2
    entry = np.zeros(rows, np.uint8)
    entry[1:] = apply[block[:-1], FRESH]
    after = apply[grid, entry].T.reshape(-1)[:n]
    before = np.empty(n, np.uint8)
    before[0] = FRESH
    before[1:] = after[:-1]
    return before


def token_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Positions where a match of the pattern starts. text_starts: position of each non-empty text's first character."""
    of_class, _, _, starts = _tables()
    kind = _classes()[points]
    n = len(points)
    first = np.zeros(n + 1, bool)
    first[text_starts] = True
    first[n] = True
    same = lambda k: ~first[k : n + 1] if k <= n else np.zeros(0, bool)
    quote = np.flatnonzero(points == ord("'"))
    if len(quote):
        near = np.append(points, [0, 0])
        one = np.where(~first[quote + 1], near[quote + 1], 0)
        two = np.where((one > 0) & ~first[np.minimum(quote + 2, n)], near[quote + 2], 0)
        kind[quote[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        pairs = [tuple(map(ord, x)) for x in ("re", "ve", "ll")]
        kind[quote[np.any([(one == a) & (two == b) for a, b in pairs], axis=0)]] = LONG
    white = kind == WHITE
    last = white.copy()
    last[:-1] &= ~white[1:]
    last &= same(1)  # at the end of its text a run stays whole
    kind[last & (points == 0x20)] = SPACE_LAST
    kind[last & (points != 0x20)] = WHITE_LAST
    before = states_before(of_class[kind + np.uint8(8) * first[:n]])
    before[text_starts] = FRESH
    return np.flatnonzero(starts[before, kind])


# ---- merging ---------------------------------------------------------------------------------------------------------
class TokenBytes:
    """Token bytes by rank."""

    def __init__(self, tokens: list[bytes]):
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray, starts: np.ndarray, total: int) -> np.ndarray:
        """The bytes of tokens whose first bytes lie at `starts` of `total` bytes."""
        size = np.diff(np.append(starts, total))
        return self.blob[np.repeat(self.offsets[ids] - starts, size) + np.arange(total)]


class Vocabulary(TokenBytes):
    """Also the rank that two neighbouring tokens merge to, and the pieces met so far."""

    MOST_CACHED = 120_000

    def __init__(self, tokens: list[bytes]):
        super().__init__(tokens)
        self.tokens = tokens
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        found = {}
        for i, t in enumerate(tokens):
            for k in range(1, len(t)):
                a, b = self.ranks.get(t[:k]), self.ranks.get(t[k:])
                if a is not None and b is not None:
                    found[a << 20 | b] = i
        keys = np.array(sorted(found), np.int64)
        self.keys, self.merged = keys, np.array([found[k] for k in keys.tolist()], np.int64)
        bits = 19
        slot = self._slot(keys, bits)
        # an open hash table with linear probing, filled in vectors
        self.bits, size = bits, 1 << bits
        self.table, self.value = np.full(size + 64, -1, np.int64), np.zeros(size + 64, np.int64)
        todo, self.probes = np.arange(len(keys)), 1
        while len(todo):
            at = slot[todo] + self.probes - 1
            free = self.table[at] < 0
            order = np.unique(at[free], return_index=True)[1]
            put = todo[free][order]
            self.table[at[free][order]], self.value[at[free][order]] = keys[put], self.merged[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            self.probes += bool(len(todo))
        self.clear()

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.begin, self.size, self.used, self.known = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0, 0

    NONE = 1 << 40

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 20 | right
        slot, out = self._slot(keys, self.bits), np.full(len(keys), self.NONE, np.int64)
        todo = np.arange(len(keys))
        for k in range(self.probes):
            at = slot[todo] + k
            found = self.table[at]
            hit = found == keys[todo]
            out[todo[hit]] = self.value[at[hit]]
            todo = todo[~hit & (found >= 0)]
        return out

    def merge_long(self, piece: bytes) -> list[int]:
        """One piece by a heap of mergeable pairs, leftmost lowest rank first."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        rank = lambda x, y: self.ranks.get(self.tokens[x] + self.tokens[y])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i], ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if 0 <= x and y < n and (q := rank(ids[x], ids[y])) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def merge_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of many pieces, laid end to end, and their number for each piece.

        In each round every piece merges its leftmost pair of lowest rank.
        """
        sizes = np.array([len(p) for p in pieces], np.int64)
        ids = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        done_ids, done_owner = [], []
        while len(ids):
            rank = np.full(len(ids), self.NONE, np.int64)
            near = np.flatnonzero(owner[1:] == owner[:-1])
            rank[near] = self.rank_of(ids[near], ids[near + 1])
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(rank << 16 | (np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))), first)
            active = (least >> 16) < self.NONE
            whole = np.repeat(active, np.diff(np.append(first, len(ids))))
            done_ids.append(ids[~whole])
            done_owner.append(owner[~whole])
            at = first[active] + (least[active] & 0xFFFF)
            ids[at] = least[active] >> 16
            whole[at + 1] = False
            ids, owner = ids[whole], owner[whole]
        ids, owner = np.concatenate(done_ids or [ids]), np.concatenate(done_owner or [owner])
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(pieces))

    def learn(self, pieces: list[str]) -> None:
        """Put new pieces into the cache."""
        short, short_ids, ready = [], [], []
        for p in pieces:
            raw = p.encode()
            if (r := self.ranks.get(raw)) is not None:
                ready.append((p, [r]))
            elif len(raw) > 40:
                ready.append((p, self.merge_long(raw)))
            else:
                short.append(raw)
                short_ids.append(p)
        ids, counts = self.merge_all(short) if short else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        names = short_ids + [p for p, _ in ready]
        counts = np.concatenate([counts, np.array([len(x) for _, x in ready], np.int64)])
        ids = np.concatenate([ids, np.array([t for _, x in ready for t in x], np.int64)])
        need, more = self.used + len(ids), self.known + len(names)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(need, len(self.flat)), np.uint32)])
        if more > len(self.begin):
            grow = np.zeros(max(more, len(self.begin)), np.int64)
            self.begin, self.size = np.concatenate([self.begin, grow]), np.concatenate([self.size, grow])
        self.flat[self.used : need] = ids
        self.begin[self.known : more] = self.used + np.cumsum(counts) - counts
        self.size[self.known : more] = counts
        self.at.update(zip(names, range(self.known, more), strict=True))
        self.used, self.known = need, more

    def encode(self, texts: str, text_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of texts laid end to end, and the position of each text's first character as a position in the ids."""
        points = np.frombuffer(texts.encode("utf-32-le"), np.uint32)
        if not len(points):
            return np.zeros(0, np.uint32), np.zeros(len(text_starts), np.int64)
        begins = token_starts(points, text_starts[text_starts < len(points)])
        bounds = begins.tolist()
        pieces = [texts[a:b] for a, b in zip(bounds, [*bounds[1:], len(points)], strict=True)]
        if self.known > self.MOST_CACHED:
            self.clear()
        if new := set(pieces).difference(self.at):
            self.learn(list(new))
        which = np.fromiter(map(self.at.__getitem__, pieces), np.int64, len(pieces))
        size = self.size[which]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.begin[which] - ends + size, size) + np.arange(ends[-1])]
        return ids, np.append(0, ends)[np.searchsorted(begins, text_starts)]


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank from a public rank file (base64 bytes, rank)."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return sorted(ranks, key=ranks.__getitem__)


_KEPT: dict[tuple[type, str], TokenBytes] = {}


def _kept(kind: type, shared: Shared) -> TokenBytes:
    """A worker process builds its tables once."""
    if (kind, shared.id) not in _KEPT:
        _KEPT[kind, shared.id] = kind(shared.value)
    return _KEPT[kind, shared.id]


class Shared:
    """The vocabulary as a broadcast variable: its size is the rank file's, whatever the corpus."""

    def __init__(self, spark, path: str):
        self.variable, self.id = spark.sparkContext.broadcast(read_ranks(path)), path

    @property
    def value(self) -> list[bytes]:
        return self.variable.value


def _binary(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Rows of little-endian unsigned 32-bit integers."""
    offsets = (bounds * 4).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(flat.astype("<u4"))])


def _with(batch: pa.RecordBatch, names: list[str], columns: list[pa.Array]) -> pa.RecordBatch:
    keep = [n for n in batch.schema.names if n not in names]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + columns, names=keep + names)


def _schema(df: DataFrame, names: list[str]) -> T.StructType:
    return T.StructType([f for f in df.schema if f.name not in names] + [T.StructField(n, T.BinaryType()) for n in names])


def encode(df: DataFrame, ranks_path: str, text_col: str = "text", and_decode: bool = False) -> DataFrame:
    """Adds token_ids and token_starts (each token's first byte): binary, little-endian unsigned 32-bit integers.

    and_decode: also `decoded`, as `decode` makes it of these two, in the same pass.
    """
    shared, names = Shared(df.sparkSession, ranks_path), ["token_ids", "token_starts"] + ["decoded"] * and_decode

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _kept(Vocabulary, shared)
        for whole in batches:
            for batch in C.slices(whole, text_col, 1 << 19):
                data, offsets = C.string_bytes(batch.column(text_col))
                texts = data.tobytes().decode()
                lead = np.append(0, np.cumsum((data & 0xC0) != 0x80))
                ids, first = vocabulary.encode(texts, lead[offsets])
                size = vocabulary.lengths[ids]
                starts = np.cumsum(size) - size
                starts = starts - np.repeat(offsets[:-1], np.diff(first))
                made = [_binary(ids, first), _binary(starts, first)]
                yield _with(batch, names, made + [_decoded(vocabulary, ids, starts, first)] * and_decode)

    return df.mapInArrow(run, _schema(df, names))


def _decoded(tokens: TokenBytes, ids: np.ndarray, starts: np.ndarray, first: np.ndarray) -> pa.Array:
    """The bytes of each row's tokens; first: n + 1 bounds of the rows in the ids."""
    size = np.append(0, np.cumsum(tokens.lengths[ids]))[first]
    flat = tokens.decode(ids, starts + np.repeat(size[:-1], np.diff(first)), int(size[-1]))
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(size.astype(np.int32)), pa.py_buffer(flat)])


def decode(df: DataFrame, ranks_path: str) -> DataFrame:
    """Adds decoded (the UTF-8 bytes) from token_ids and the retained token_starts."""
    shared = Shared(df.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _kept(TokenBytes, shared)
        for whole in batches:
            for batch in C.slices(whole, "token_ids", 1 << 20):
                raw, bounds = C.string_bytes(batch.column("token_ids"))
                ids = np.frombuffer(raw.tobytes(), "<u4")
                starts = np.frombuffer(C.string_bytes(batch.column("token_starts"))[0].tobytes(), "<u4").astype(np.int64)
                yield _with(batch, ["decoded"], [_decoded(tokens, ids, starts, bounds // 4)])

    return df.mapInArrow(run, _schema(df, ["decoded"]))
