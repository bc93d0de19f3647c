"""Benchmark decontamination by latent semantic retrieval.

Words are hashed into TF-IDF features; document frequencies count all documents.
A randomised SVD of the TF-IDF passages of all documents is fitted once, by tasks that
each return one sketch of fixed size, added up in a tree. Items are taken in blocks of
about as many as the latent space has directions; each block's space is the SVD of its
items (weighted to hold most of the energy) and the corpus's directions, so how much of
an item it holds doesn't depend on the number of items. Windows of every document,
of about an item's length and a quarter of it apart, are compared with the items by the
cosine of window and latent item, each divided by its own norm, if the text has a part that
holds enough of the item's words for the confirmation. Candidates are confirmed on
the words themselves: by the longest common subsequence of item and place, and of the
item's answer (its last third) and place, so that paraphrases are found and chance
resemblance is not.

Documents are read once for every `PASS` items, so what is broadcast is bounded whatever the
benchmark's size. Null and empty texts, and items without words, match nothing.
Repeated items each match. Extra columns pass through; the column made here
(matches) replaces one of that name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcore as C
from .tables import written

BITS, RANK, OVERSAMPLE, POWER = 14, 96, 16, 2
#: Directions fitted on the documents, items that share a latent space, items of a pass over the documents, passes in a stage, words of a passage.
CORPUS, ITEMS, PASS, PASSES, PASSAGE = 32, 96, 512, 4, 32
#: Sketches are cut into so many parts, and so many tasks' sketches are added up at a time.
PARTS, FAN, LEVELS = 16, 32, 3
STEP, WINDOWS = 4, (16, 32, 64)
COSINE = 0.22
#: Shares of an item's words in common order that confirm it: alone, or with such a share of its answer.
LCS_ALONE, LCS, ANSWER = 0.8, 0.5, 0.6
MATCH = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("lcs", T.DoubleType()), T.StructField("answer", T.DoubleType())])


def words_of(column: pa.Array) -> C.Words:
    data, offsets = C.string_bytes(column)
    return C.Words(C.folded(data), offsets, C.ALNUM_LOWER)


def features(words: C.Words) -> np.ndarray:
    return (words.hashes >> np.uint64(64 - BITS)).astype(np.int64)


def _parts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        yield from C.slices(whole, column, 1 << 19)


def inverse_frequencies(docs: DataFrame, text_col: str) -> np.ndarray:
    """Over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << BITS, np.int64), 0
        for batch in _parts(batches, text_col):
            words = words_of(batch.column(text_col))
            text = np.repeat(np.arange(batch.num_rows), words.counts())
            total += np.bincount(np.unique(text << BITS | features(words)) & ((1 << BITS) - 1), minlength=1 << BITS)
            n += batch.num_rows
        at = np.append(np.flatnonzero(total), 1 << BITS)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(total, n)[at])], names=["feature", "n"])

    rows = docs.select(text_col).mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    found = np.zeros((1 << BITS) + 1)
    for r in rows:
        found[r.feature] = r.n
    return np.log((1 + found[-1]) / (1 + found[:-1])) + 0.05


def _sketch(feature: np.ndarray, place: np.ndarray, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'A basis for the passages A (rows of length one) of the words at these places of their texts: features x columns."""
    slot = place % PASSAGE
    passage = np.cumsum(slot == 0) - 1
    n = int(passage[-1]) + 1 if len(passage) else 0
    weight = idf[feature]
    size = np.sqrt(np.bincount(passage, weight * weight, minlength=n))
    weight = (weight / np.where(size > 0, size, 1)[passage]).astype(np.float32)
    feature = feature.astype(np.uint16)  # sorted by their digits
    out = np.zeros(basis.shape, np.float32)
    for a in range(0, n, 8192):
        at = slice(*np.searchsorted(passage, [a, a + 8192]))
        f, p, w = feature[at], passage[at] - a, weight[at]
        rows = int(p[-1]) + 1
        features_of, weights_of = np.zeros((rows, PASSAGE), np.uint16), np.zeros((rows, 1, PASSAGE), np.float32)
        features_of[p, slot[at]] = f
        weights_of[p, 0, slot[at]] = w
        projected = np.empty((rows, basis.shape[1]), np.float32)
        for i in range(0, rows, 64):  # what is gathered at a time stays in the cache
            projected[i : i + 64] = np.matmul(weights_of[i : i + 64], basis[features_of[i : i + 64]])[:, 0]
        order = np.argsort(f, kind="stable")
        f, p, w = f[order], p[order], w[order, None]
        first = np.flatnonzero(np.append(True, f[1:] != f[:-1]))
        ends, i = np.append(first[1:], len(f)), 0
        while i < len(first):
            j = max(i + 1, int(np.searchsorted(first, first[i] + 4096)))
            some = slice(first[i], ends[j - 1])
            back = projected[p[some]]
            back *= w[some]
            out[f[first[i:j]]] += np.add.reduceat(back, first[i:j] - first[i], axis=0)
            i = j
    return out


def corpus_directions(docs: DataFrame, text_col: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """CORPUS leading right singular vectors (features x directions) of all documents' passages, and their singular values."""
    width = min(CORPUS + OVERSAMPLE, 1 << BITS)
    basis = np.linalg.qr(np.random.default_rng(7).standard_normal((1 << BITS, width)))[0].astype(np.float32)
    context = docs.sparkSession.sparkContext
    left, values = np.eye(width), np.zeros(width)
    for _ in range(POWER):
        shared = context.broadcast(basis)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total, task = np.zeros(shared.value.shape, np.float32), TaskContext.get().partitionId()
            for batch in _parts(batches, text_col):
                words = words_of(batch.column(text_col))
                place = np.arange(len(words)) - np.repeat(words.first[:-1], words.counts())
                total += _sketch(features(words), place, idf, shared.value)
            step = len(total) // PARTS
            sums = [total[i * step : (i + 1) * step].tobytes() for i in range(PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS)), pa.array([task] * PARTS, pa.int64()), pa.array(sums, pa.binary())], names=["part", "task", "sums"])

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x, np.float32) for x in table.column("sums").to_pylist())
            return pa.table({"part": table.column("part")[:1], "task": table.column("task")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

        parts = docs.select(text_col).mapInArrow(run, "part long, task long, sums binary")
        for level in range(LEVELS):
            group = F.expr(f"task div {FAN}") if level < LEVELS - 1 else F.col("task") * 0
            parts = parts.withColumn("task", group).groupBy("part", "task").applyInArrow(add, "part long, task long, sums binary")
        parts = parts.collect()
        if not parts:
            break
        product = np.concatenate([np.frombuffer(r.sums, np.float32) for r in sorted(parts, key=lambda r: r.part)]).reshape(basis.shape)
        basis, triangle = np.linalg.qr(product.astype(np.float64))
        left, values, _ = np.linalg.svd(triangle)
        basis = basis.astype(np.float32)
    return (basis @ left[:, :CORPUS]).astype(np.float32), np.sqrt(values[:CORPUS])


def latent_items(words: C.Words, idf: np.ndarray, directions: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Items x features: TF-IDF vectors of a block of items in the latent space of items and corpus, of length one."""
    n = len(words.first) - 1
    owner = np.repeat(np.arange(n), words.counts())
    rows = np.bincount(owner << BITS | features(words), minlength=n << BITS).reshape(n, -1) * idf
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    rows /= np.where(size > 0, size, 1)
    energy = np.linalg.norm(values**2)
    weight = 2 * np.sqrt(energy / max(np.linalg.norm(rows @ rows.T), 1e-9)) if energy > 0 else 1.0
    whole = np.concatenate([rows * weight, (directions * values).T])
    squares, left = np.linalg.eigh(whole @ whole.T)
    held = np.flatnonzero(squares > 1e-9 * max(squares[-1], 1e-9))[-RANK:]
    basis = whole.T @ (left[:, held] / np.sqrt(squares[held]))
    latent = rows @ basis
    size = np.linalg.norm(latent, axis=1, keepdims=True)
    return (latent / np.where(size > 0, size, 1)) @ basis.T


def lcs(item: list[int], place: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in place:
        if m := masks.get(w):
            both = row & m
            row = ((row + both) | (row - both)) & full
    return len(item) - row.bit_count()


class Items:
    """Items of a pass with their latent vectors, fitted for each block of ITEMS."""

    def __init__(self, ids: list[int], texts: list[str], idf: np.ndarray, directions: np.ndarray, values: np.ndarray):
        self.ids, self.words = ids, []
        blocks = []
        for a in range(0, len(ids), ITEMS):
            words = words_of(pa.array(texts[a : a + ITEMS], pa.string()))
            self.words += [words.hashes[x:y].tolist() for x, y in zip(words.first, words.first[1:], strict=False)]
            blocks.append((latent_items(words, idf, directions, values) * idf).astype(np.float32))
        self.squares = np.append(idf * idf, 0).astype(np.float32)
        counts = np.array([len(w) for w in self.words])
        # the window of each item is the largest that isn't longer, or the smallest
        choice = np.maximum(np.searchsorted(WINDOWS, counts, "right") - 1, 0)
        self.classes = [(w, np.flatnonzero((choice == i) & (counts > 0))) for i, w in enumerate(WINDOWS)]
        #: items x features, a column of zeros at the end
        self.weights = np.zeros((len(ids), (1 << BITS) + 1), np.float32)
        self.weights[:, :-1] = np.concatenate(blocks)
        #: the distinct words of all items, and which each item's words are
        self.known = np.unique(np.array([w for x in self.words for w in x], np.uint64))
        self.phrases = [np.searchsorted(self.known, np.array(x, np.uint64)) for x in self.words]


def possible(words: C.Words, items: Items, window: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (text, item) of which some place may hold LCS of the item's words; no other pair can be confirmed.

    Texts are cut into parts as long as the longest place, so a place lies in two parts that follow each other.
    """
    sizes = np.array([len(items.phrases[i]) for i in ids])
    longest = window + 2 * int(sizes.max())
    counts = words.counts()
    parts = -(-counts // longest)
    begin = np.append(0, np.cumsum(parts))
    text_of_word = np.repeat(np.arange(len(counts)), counts)
    part = begin[text_of_word] + (np.arange(len(words)) - words.first[text_of_word]) // longest
    index = np.minimum(np.searchsorted(items.known, words.hashes), len(items.known) - 1)
    there = np.flatnonzero(items.known[index] == words.hashes)
    part, index = part[there], index[there]
    text_of_part = np.repeat(np.arange(len(counts)), parts)
    phrase, starts = np.concatenate([items.phrases[i] for i in ids]), np.append(0, np.cumsum(sizes[:-1]))
    texts, found = [], []
    for a in range(0, len(text_of_part), 1024):
        owner = text_of_part[a : a + 1025]  # with the part that follows
        at = slice(*np.searchsorted(part, [a, a + len(owner)]))
        held = np.zeros((len(items.known), len(owner)), np.uint8)
        held[index[at], part[at] - a] = 1
        held[:, :-1] |= held[:, 1:] * (owner[1:] == owner[:-1])
        hits = np.add.reduceat(held[phrase], starts, axis=0, dtype=np.int32)[:, :1024]
        item, row = np.nonzero(hits >= LCS * sizes[:, None])
        texts.append(owner[row])
        found.append(item)
    pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *texts]) * len(ids) + np.concatenate([np.zeros(0, np.int64), *found]))
    return pairs // len(ids), ids[pairs % len(ids)]


def _double(sums: np.ndarray, owner: np.ndarray, by: int) -> None:
    """Adds to each block's sum that of the block `by` further on, if its owner is the same."""
    if by < len(sums):
        sums[:-by] += sums[by:] * (owner[by:] == owner[:-by])


def search(words: C.Words, items: Items) -> dict[int, list[tuple]]:
    """Confirmed matches by text."""
    counts = words.counts()
    padded = -(-counts // STEP) * STEP
    begin = np.append(0, np.cumsum(padded))
    index = np.full(int(begin[-1]), 1 << BITS, np.int64)
    text_of_word = np.repeat(np.arange(len(counts)), counts)
    index[np.arange(len(words)) - words.first[text_of_word] + begin[text_of_word]] = features(words)
    squares = items.squares[index].reshape(-1, STEP).sum(axis=1)
    index = index.reshape(-1, STEP)
    text_of_block = np.repeat(np.arange(len(counts)), padded // STEP)
    width, found = STEP, []
    for window, ids in items.classes:
        while width < window:  # windows near the end of a text go over what there is
            _double(squares, text_of_block, width // STEP)
            width *= 2
        if not len(ids) or not len(index):
            continue
        size = np.sqrt(np.maximum(squares, 1e-9))
        texts, chosen = possible(words, items, window, ids)
        blocks = padded[texts] // STEP
        ends = np.cumsum(blocks)
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] - blocks[a] + (1 << 16), "right")))
            pair = np.repeat(np.arange(a, b), blocks[a:b])
            block = np.arange(len(pair)) - (ends - blocks)[pair] + (ends[a] - blocks[a]) + begin[texts[pair]] // STEP
            item = chosen[pair]
            near = items.weights[item, index[block, 0]]
            for k in range(1, STEP):
                near += items.weights[item, index[block, k]]
            reach = STEP
            while reach < window:
                _double(near, pair, reach // STEP)
                reach *= 2
            row = np.flatnonzero(near >= COSINE * size[block])
            block, near = block[row], near[row]
            found.append(np.stack([text_of_block[block], item[row], block, near / size[block], np.full(len(row), window)], axis=1))
            a = b
    out: dict[int, list[tuple]] = {}
    if not found:
        return out
    table = np.concatenate(found)
    table = table[np.lexsort((table[:, 2], -table[:, 3], table[:, 1], table[:, 0]))]
    hashes, last, tried = words.hashes, None, []
    best = None
    for text, item, block, cosine, window in [*table.tolist(), (-1, -1, 0, 0, 0)]:
        if (text, item) != last:
            if best:
                out.setdefault(int(last[0]), []).append(best)
            last, tried, best = (text, item), [], None
            if text < 0:
                break
            text, item = int(text), int(item)
        at = int(block * STEP - begin[int(text)])
        if best or any(a <= at < b for a, b in tried):
            continue
        phrase = items.words[int(item)]
        m, start = len(phrase), int(words.first[int(text)])
        a, b = max(0, at - m), min(int(counts[int(text)]), at + int(window) + m)
        tried.append((at - m // 2, at + m // 2))
        place = hashes[start + a : start + b].tolist()
        if sum(map(set(place).__contains__, phrase)) < LCS * m:
            continue  # a common subsequence can't be longer than the item's words that the place has
        share = lcs(phrase, place) / m
        if share >= LCS:
            end = phrase[-max(1, m // 3) :]
            answer = lcs(end, place) / len(end)
            if share >= LCS_ALONE or answer >= ANSWER:
                best = (items.ids[int(item)], max(0, at), cosine, share, answer)
    return out


def find(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Adds matches: item_id, first_word of the best window, cosine, and shares of item and answer found in order."""
    spark = docs.sparkSession
    fields = [f for f in docs.schema if f.name != "matches"]
    schema = T.StructType(fields + [T.StructField("matches", T.ArrayType(MATCH))])
    idf = inverse_frequencies(docs, text_col)
    names = [f.name for f in fields]
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("text")).where("text is not null").orderBy("id", "text")
    done = docs.withColumn("matches", F.lit(None).cast(schema["matches"].dataType))
    block: list = []
    fitted, passes = None, 0
    for row in [*items.toLocalIterator(), None]:
        if row is not None:
            block.append(row)
        if block and (row is None or len(block) == PASS):
            fitted = fitted or corpus_directions(docs, text_col, idf)
            shared = spark.sparkContext.broadcast(Items([r.id for r in block], [r.text for r in block], idf, *fitted))
            if passes and passes % PASSES == 0:  # each pass of a stage has a worker
                done = written(done, "searched")
            passes += 1

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                for batch in _parts(batches, text_col):
                    found = search(words_of(batch.column(text_col)), shared.value)
                    before = batch.column("matches")
                    keys = [f.name for f in MATCH]
                    rows = [(before[i].as_py() or []) + [dict(zip(keys, m, strict=True)) for m in found.get(i, [])] for i in range(batch.num_rows)]
                    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("first_word", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.float64())]))
                    yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(rows, kind)], names=[*names, "matches"])

            done, block = done.mapInArrow(run, schema), []
    return done.withColumn("matches", F.coalesce("matches", F.array().cast(schema["matches"].dataType)))
