"""Substring dedup: repeated passages found and removed with sharded automata.

A window is `WINDOW` consecutive words of one document. Detection: of each window
the least hash of its 20-word shingles is its seed, so equal windows have equal
seeds; a fingerprint exchange finds the seeds that recur anywhere. Confirmation:
a second exchange, of the 64-bit hashes of the windows with recurring seeds, finds
the windows that recur. Location: the confirmed windows of a block are compiled
into Aho-Corasick automata of bounded size, and all documents of the block are
streamed through them; every word covered by an occurrence is removed.

The symbols of the automata are 24-bit hashes of `STRIDE` words, and a pattern has
WINDOW / STRIDE of them, so each document is streamed once per phase. An occurrence
counts only if the 64-bit hash of its whole window is the pattern's. Two different
windows are taken for equal only if their 64-bit hashes collide (chance below
1e-4 for a billion windows).

Null and empty texts have no words. Repeated rows are separate documents. Extra
columns pass through; columns with the names made here are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcore as C
from .exchange import blocks, contains, flagged, recurring, unpack

WINDOW, SHINGLE, STRIDE, DIGITS = 35, 20, 7, 4
#: Patterns in one automaton.
SHARD = 50_000


class Windows:
    """Word hashes, seeds and window hashes of one block."""

    def __init__(self, batch: pa.RecordBatch, text_col: str):
        data, offsets = C.string_bytes(batch.column(text_col))
        self.words = C.Words(data, offsets, C.NON_SPACE)
        n = len(self.words)
        self.whole = np.flatnonzero(self.words.inside(WINDOW))
        self.shingles = C.grams(self.words.hashes, SHINGLE, 1)
        least = self.shingles.copy()
        for step in (1, 2, 4, 8):  # minima of 16 shingles, those of a window
            least[:-step] = np.minimum(least[:-step], least[step:])
        self.least = np.zeros(n, np.uint64)
        self.least[self.whole] = least[self.whole]

    def seeds(self) -> np.ndarray:
        """Shingles at every place where one is the least of a window."""
        if not len(self.whole):
            return np.zeros(0, np.uint64)
        most = self.least.copy()
        for step in (1, 2, 4, 8):  # of the windows that a shingle is in, the one with the largest minimum
            most[step:] = np.maximum(most[step:], most[:-step])
        most = most[: len(self.shingles)]
        return self.shingles[(most == self.shingles) & (most > 0)]

    def hashes(self) -> np.ndarray:
        return C.grams(self.words.hashes, WINDOW, 2)

    def candidates(self, recurring_seeds: np.ndarray) -> np.ndarray:
        """Starts of the windows with recurring seeds."""
        return self.whole[contains(recurring_seeds, self.least[self.whole])]


def _digits(symbols: np.ndarray) -> np.ndarray:
    """Symbols as rows of DIGITS characters of 6 bits: a node of an automaton has 64 branches at most."""
    shifts = np.arange(0, 6 * DIGITS, 6, dtype=np.uint64)
    return ((symbols[:, None] >> shifts & np.uint64(63)) + np.uint64(0x30)).astype(np.uint8)


def covered(words: C.Words, hashes: np.ndarray, starts: np.ndarray, confirmed: np.ndarray) -> np.ndarray:
    """Whether each word lies in an occurrence of a confirmed window, by streaming all texts through the automata.

    starts: the windows in which the confirmed hashes are, to take the patterns from.
    """
    n = len(words)
    change = np.zeros(n + 1, np.int64)
    starts = starts[contains(confirmed, hashes[starts])]
    patterns = starts[np.unique(hashes[starts], return_index=True)[1]]
    symbols = C.grams(words.hashes, STRIDE, 3)
    text = np.repeat(np.arange(len(words.first) - 1), words.counts())[: len(symbols)]
    inside = words.inside(STRIDE)[: len(symbols)]
    phase = (np.arange(len(symbols)) - words.first[text]) % STRIDE
    streams = []
    for k in range(STRIDE):
        at = np.flatnonzero(inside & (phase == k))
        breaks = np.flatnonzero(np.diff(text[at])) + 1  # a text ends with a character of its own
        stream = np.insert(_digits(symbols[at]), breaks, 0x0A, axis=0)
        streams.append((stream.tobytes().decode("latin-1"), np.insert(at, breaks, -1)))
    steps = np.arange(0, WINDOW, STRIDE)
    for a in range(0, len(patterns), SHARD):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        part = patterns[a : a + SHARD]
        keys = _digits(symbols[(part[:, None] + steps).reshape(-1)]).tobytes().decode("latin-1")
        width = DIGITS * len(steps)
        for i, at in enumerate(part.tolist()):
            automaton.add_word(keys[i * width : (i + 1) * width], at)
        automaton.make_automaton()
        for stream, place in streams:
            found = list(automaton.iter(stream))
            if found:
                ends, which = np.array(found).T
                whole = (ends + 1) % DIGITS == 0
                begin, which = place[(ends[whole] + 1) // DIGITS - len(steps)], which[whole]
                begin = begin[hashes[begin] == hashes[which]]
                np.add.at(change, begin, 1)
                np.add.at(change, begin + WINDOW, -1)
    return np.cumsum(change[:-1]) > 0


def kept_bytes(words: C.Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept words of each text joined by one space: bytes and offsets."""
    data = words.data.copy()
    level = np.zeros(len(data) + 1, np.int8)
    level[words.starts[keep]] = 1
    level[words.ends[keep]] -= 1
    take = np.cumsum(level[:-1], dtype=np.int8).astype(bool)
    text = np.repeat(np.arange(len(words.first) - 1), words.counts())[keep]
    followed = np.flatnonzero(keep)[:-1][text[1:] == text[:-1]] if len(text) else np.zeros(0, np.int64)
    gap = words.ends[followed]
    take[gap], data[gap] = True, 0x20
    return data[take], np.append(0, np.cumsum(take))[words.offsets]


ADDED = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("kept_text", T.StringType()),
    T.StructField("removed_spans", T.ArrayType(T.StructType([T.StructField("first_word", T.LongType()), T.StructField("n", T.LongType())]))),
]


def _spans(removed: np.ndarray, words: C.Words) -> pa.Array:
    """For each text the runs of removed words: index of the first within the text, and their number."""
    edge = np.zeros(len(removed) + 1, bool)
    edge[words.first] = True
    inside = np.concatenate([[False], removed, [False]])
    begin = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    owner = np.searchsorted(words.first, begin, "right") - 1
    inner = pa.StructArray.from_arrays([pa.array(begin - words.first[owner]), pa.array(end - begin)], names=["first_word", "n"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(begin, words.first), pa.int32()), inner)


def remove_repeats(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, n_removed, kept_text and removed_spans (first word, number of words) to every row."""
    table = blocks(df, text_col, "blocks")
    fields = [f for f in df.schema if f.name not in {a.name for a in ADDED}]
    total = table.agg(F.sum(F.length("payload"))).first()[0] or 0

    def seeds_of(row: dict) -> np.ndarray:
        return Windows(unpack(row["payload"]), text_col).seeds()

    seeds, seed_owners = recurring(table, seeds_of, total // 20, "seeds")

    def windows_of(row: dict) -> np.ndarray:
        windows = Windows(unpack(row["payload"]), text_col)
        return windows.hashes()[windows.candidates(flagged(windows.seeds(), row["bitmaps"], seed_owners))]

    # blocks are joined alike at every size: a broadcast of the bitmaps would grow with the table
    with_seeds = table.join(seeds.hint("shuffle_merge"), "block_id")
    confirmed, owners = recurring(with_seeds, windows_of, total // 10, "windows")

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(rows.num_rows):
                row = {n: rows.column(n)[i].as_py() for n in rows.schema.names}
                batch = unpack(row["payload"])
                windows = Windows(batch, text_col)
                words, removed = windows.words, np.zeros(len(windows.words), bool)
                if row["found"]:
                    hashes = windows.hashes()
                    starts = windows.candidates(flagged(windows.seeds(), row["bitmaps"], seed_owners))
                    sure = flagged(hashes[starts], row["found"], owners)
                    if len(sure):
                        removed = covered(words, hashes, starts, sure)
                flat, offsets = kept_bytes(words, ~removed)
                lost = np.append(0, np.cumsum(removed))[words.first]
                text = pa.Array.from_buffers(pa.string(), batch.num_rows, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat)])
                made = [pa.array(words.counts()), pa.array(np.diff(lost)), text, _spans(removed, words)]
                yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in fields] + made, names=[f.name for f in fields] + [a.name for a in ADDED])

    found = confirmed.withColumnRenamed("bitmaps", "found")
    return table.join(seeds.hint("shuffle_merge"), "block_id", "left").join(found.hint("shuffle_merge"), "block_id", "left").mapInArrow(locate, T.StructType(fields + ADDED))
