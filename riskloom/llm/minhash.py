"""Near-duplicate detection with SuperMinHash signatures.

Each shingle of a set walks through a random permutation of the signature's
components; at step j it offers the value j + r (r uniform in [0, 1)) to the j-th
component of its permutation, and a component keeps its least offer. All shingles
of a text take step j together, and a text stops when no component can fall any
further, which long texts reach after a few steps. Sets are banded; in each
bucket every set is linked with the bucket's smallest, links are confirmed on the
full shingle sets. Sets in buckets that then span several groups are compared
across groups too, by their rarest shingles. Groups come from union-find.

With 125 components in 25 bands of 5, a pair of similarity 0.85 shares no band
with probability 4e-7 (0.8: 5e-5).

Null and empty texts, and texts without words, have an empty set and are linked
with nothing. Texts with fewer words than a shingle have one shingle, the whole
sequence. Equal sets are one node. Rows are told apart by themselves: rows of one id with
different texts are documents of their own, and a component's id is the smallest in it,
null only if all are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcore as C
from .components import components
from .ngram_join import between, indexed
from .tables import written
from .textcore import shingle_sets

BANDS, ROWS = 25, 5
SIZE = BANDS * ROWS


def super_minhash(hashes: np.ndarray, bounds: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Signatures (texts x size) of sets of hashes; the value of an empty set is 2**63 everywhere.

    A value holds the step in its high and r in its low 40 bits.
    """
    n = len(bounds) - 1
    out = np.full((n, size), 1 << 63, np.uint64)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    place = np.tile(np.arange(size, dtype=np.uint8), (len(hashes), 1))
    active = np.arange(len(hashes))
    for j in range(size):
        if not len(active):
            break
        draw = C.mix(hashes[active] + np.uint64((0x632BE59BD9B4E019 * (j + 1)) & (2**64 - 1)))
        k = j + ((draw >> np.uint64(40)) * np.uint64(size - j) >> np.uint64(24)).astype(np.int64)
        chosen = place[active, k]
        place[active, k] = place[active, j]
        place[active, j] = chosen
        offer = (np.uint64(j) << np.uint64(40)) | (draw & np.uint64((1 << 40) - 1))
        np.minimum.at(flat, owner[active] * size + chosen, offer)
        # a text is finished when every component has an offer of this step or an earlier one
        open_texts = (out >= np.uint64((j + 1) << 40)).any(axis=1)
        active = active[open_texts[owner[active]]]
    return out


def bands(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, different for different bands."""
    n = len(signatures)
    out = np.empty((n, BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(n, 0x9E3779B97F4A7C15 + b, np.uint64)
        for r in range(ROWS):
            key = C.mix(key * np.uint64(31) + signatures[:, b * ROWS + r])
        out[:, b] = key
    return out


def _sign(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", T.LongType()), T.StructField("packed", T.BinaryType()), T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, at = zstandard.ZstdCompressor(3), TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in C.slices(whole, text_col, 1 << 20):
                hashes, bounds = shingle_sets(batch.column(text_col), width)
                sizes = np.diff(bounds)
                keys = np.empty((batch.num_rows, BANDS), np.uint64)
                ends = np.append(np.searchsorted(bounds, np.arange(0, len(hashes), 100_000)), batch.num_rows)
                for a, b in zip(np.unique(ends), np.unique(ends)[1:], strict=False):
                    part = hashes[bounds[a] : bounds[b]]
                    keys[a:b] = bands(super_minhash(part, bounds[a : b + 1] - bounds[a]))
                if ends[0] > 0:
                    keys[: ends[0]] = bands(super_minhash(hashes[: bounds[ends[0]]], bounds[: ends[0] + 1]))
                digest = [hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() for a, b in zip(bounds, bounds[1:], strict=False)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, batch.num_rows * BANDS + 1, BANDS), pa.int32()), pa.array(keys.view(np.int64).reshape(-1)))
                rows = pa.array(at + np.arange(batch.num_rows))
                at += batch.num_rows
                yield pa.RecordBatch.from_arrays([rows, batch.column(id_col).cast(pa.int64()), pa.array([packer.compress((t or "").encode()) for t in batch.column(text_col).to_pylist()], pa.binary()), pa.array(sizes), pa.array(digest, pa.binary()), lists], names=schema.names)

    return df.select(id_col, text_col).mapInArrow(run, schema)


def _confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    left = texts.select(F.col("set_id").alias("a"), F.col("packed").alias("text_a"))
    right = texts.select(F.col("set_id").alias("b"), F.col("packed").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for whole in batches:
            for batch in C.slices(whole, "text_a", 1 << 18):
                sides = [pa.array([unpacker.decompress(t) for t in batch.column(c).to_pylist()], pa.binary()) for c in ("text_a", "text_b")]
                (first, at), (second, to) = (shingle_sets(x, width) for x in sides)
                sure = []
                for i in range(batch.num_rows):
                    x, y = first[at[i] : at[i + 1]], second[to[i] : to[i + 1]]
                    both = np.intersect1d(x, y, assume_unique=True).size
                    sure.append(bool(100 * both >= percent * (len(x) + len(y) - both)))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(sure))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _across(sets: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) of sets (set_id, packed, component) of different components: all that it takes to join them.

    They meet by their rarest shingles, or by pairs of frequent ones, and are confirmed on the full sets; where a
    key has many sets, those of different components are united in blocks and told apart by bitmaps first.
    """

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for whole in batches:
            for batch in C.slices(whole, "packed", 1 << 18):
                hashes, bounds = shingle_sets(pa.array([unpacker.decompress(t) for t in batch.column("packed").to_pylist()], pa.binary()), width)
                tokens = [hashes[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column("set_id"), pa.array(np.diff(bounds)), pa.array(tokens, pa.binary())], names=["node", "n", "tokens"])

    ready = indexed(sets.select("set_id", "packed").mapInArrow(shingles, "node long, n long, tokens binary"), percent)
    index = ready.select("node", "n", "known", F.explode("keys").alias("key")).join(sets.select(F.col("set_id").alias("node"), "component"), "node")
    index = written(index, "index")
    return between(index.join(index.groupBy("key").agg(F.count(F.lit(1)).alias("n_sets")), "key"), ready, percent)


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row (id, n_shingles, component_id) per document: the smallest id reachable over links of similarity >= percent / 100."""
    signed = written(_sign(df, id_col, text_col, width), "signed")
    sets = signed.where("n_shingles > 0").groupBy("digest").agg(F.min("row").alias("set_id"), F.min("id").alias("low"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"))
    sets = written(sets, "sets")
    buckets = sets.select("set_id", "n_shingles", F.explode("keys").alias("key"))
    pivots = buckets.groupBy("key").agg(F.min(F.struct("set_id", "n_shingles")).alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1")
    pivots = pivots.select("key", F.col("pivot.set_id").alias("pivot"), F.col("pivot.n_shingles").alias("m"))
    # from here on only buckets of several sets
    shared = written(buckets.join(pivots, "key"), "shared")
    # shingle numbers that differ too much rule a link out
    near = f"100 * least(m, n_shingles) >= {percent} * greatest(m, n_shingles)"
    stars = shared.where("set_id <> pivot").where(near).select(F.col("set_id").alias("a"), F.col("pivot").alias("b")).distinct()
    wanted = shared.select("set_id").distinct()
    texts = written(signed.select(F.col("row").alias("set_id"), "packed").join(wanted, "set_id"), "texts")
    links = written(_confirm(stars, texts, width, percent), "stars")
    trees = components(links)
    # sets in buckets that span several groups: their pairs across groups
    placed = shared.select("key", "set_id").join(trees.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    placed = written(placed, "placed")
    spread = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    suspects = placed.join(spread, "key").select("set_id", "component").distinct()
    more = written(_across(written(texts.join(suspects, "set_id"), "suspects"), width, percent), "more")
    if more.limit(1).count():
        trees = components(links.union(more))
    # a set's documents have its smallest id, or that of the sets it is linked with
    linked = written(trees.join(sets.select(F.col("set_id").alias("node"), "low"), "node"), "linked")
    named = linked.join(linked.groupBy("component").agg(F.min("low").alias("label")), "component").select(F.col("node").alias("set_id"), "label")
    named = sets.select("digest", "set_id", "low").join(named, "set_id", "left").select("digest", F.coalesce("label", "low").alias("label"))
    members = signed.where("n_shingles > 0").select("id", "n_shingles", "digest").join(named, "digest").select("id", "n_shingles", F.col("label").alias("component_id"))
    return members.unionAll(signed.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id")))
