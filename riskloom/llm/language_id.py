"""Language identification by nearest centroid.

Texts are TF-IDF vectors of hashed character bigrams and trigrams, of length one.
Document frequencies count every training row. Each language gets several
centroids from spherical k-means over a bounded sample of its training rows
(`SAMPLE` distinct texts of each, those with the smallest hashes). A text takes the
language of the centroid with the highest cosine; it is rejected if that cosine is
below `MARGIN` times a low quantile of what held-out texts of the language and of about its
length have. Those are the sample's texts and their beginnings, each compared with
centroids that were fitted without the text. A language with too few texts for that
rejects below `REJECT` times the smallest cosine of the centroid's own sample.

Null texts and texts without a letter are `und` with score 0, and rejected.
Training rows without a language are left out; without any training row every text
is `und`. Ties of cosines go to the alphabetically first language. Extra columns
pass through; columns with the names made here are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcore as C
from .bpe import LETTER, _classes
from .ngrams import buckets, code_points, letters_only

BITS = 12
WIDTHS = (2, 3)
#: Rows of each language that the centroids are fitted on, and their number.
SAMPLE, CENTROIDS, ROUNDS = 400, 4, 8
REJECT = 0.15
#: Parts of a sample that are held out in turn, the least texts for it, and of a class of lengths (powers of 2).
FOLDS, ENOUGH, LENGTHS = 4, 20, 13
QUANTILE, MARGIN = 0.01, 0.65
#: Numbers of rows are broadcast for this many languages at most (16 bytes each and the name).
FEW_LABELS = 10_000
UNKNOWN = "und"


def term_counts(column: pa.Array) -> np.ndarray:
    """Texts x buckets."""
    flat, bounds = code_points(*letters_only(column))
    out = np.zeros((len(bounds) - 1) << BITS, np.float32)
    for width in WIDTHS:
        bucket, text = buckets(flat, bounds, width, BITS)
        out += np.bincount(text << BITS | bucket, minlength=len(out)).astype(np.float32)
    return out.reshape(-1, 1 << BITS)


def length_classes(column: pa.Array) -> np.ndarray:
    """Power of 2 of each text's number of letters and spaces."""
    _, bounds = code_points(*letters_only(column))
    return np.minimum(np.log2(np.maximum(np.diff(bounds), 1)).astype(np.int64), LENGTHS - 1)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Sublinear TF-IDF of length one (zero for texts without n-grams)."""
    v = np.log1p(counts) * idf
    size = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(size > 0, size, 1)


def has_letter(column: pa.Array) -> np.ndarray:
    data, offsets = C.string_bytes(column)
    letter = (C.LOWER[data] >= 0x61) & (C.LOWER[data] <= 0x7A)
    total = np.append(0, np.cumsum(letter))[offsets]
    found = np.diff(total) > 0
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        raw = data[offsets[i] : offsets[i + 1]]
        if (raw >= 0x80).any():
            points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
            found[i] = (_classes()[points] == LETTER).any()
    return found


def _pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in C.slices(whole, column, 1 << 20):
            for a in range(0, part.num_rows, 500):
                yield part.slice(a, 500)


def document_frequencies(texts: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """Over all rows; one row of fixed size for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << BITS, np.int64), 0
        for batch in _pieces(batches, text_col):
            total += (term_counts(batch.column(text_col)) > 0).sum(axis=0)
            n += batch.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, 1 << BITS)), pa.array(np.append(total[at], n))], names=["bucket", "n"])

    rows = texts.select(text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    found, count = np.zeros(1 << BITS, np.int64), 0
    for r in rows:
        if r.bucket == 1 << BITS:
            count = r.n
        else:
            found[r.bucket] = r.n
    return found, count


def k_means(v: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; starts from rows that are far from each other."""
    chosen = [v.mean(axis=0)]
    near = v @ chosen[0]
    for _ in range(1, min(k, len(v))):
        chosen.append(v[int(near.argmin())])
        near = np.maximum(near, v @ chosen[-1])
    centres = np.stack(chosen)
    for _ in range(ROUNDS):
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
        nearest = (v @ centres.T).argmax(axis=1)
        kept = [i for i in range(len(centres)) if (nearest == i).any()]
        centres = np.stack([v[nearest == i].mean(axis=0) for i in kept])
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)


def held_out_floors(texts: pa.Array, idf: np.ndarray) -> np.ndarray | None:
    """Lowest cosine of each class of lengths that isn't rejected; None with too few texts."""
    if len(texts) < ENOUGH:
        return None
    fold = np.arange(len(texts)) % FOLDS
    v = vectors(np.concatenate([term_counts(texts.slice(a, 200)) for a in range(0, len(texts), 200)]), idf)
    found: list[list[float]] = [[] for _ in range(LENGTHS)]
    whole = texts.to_pylist()
    for i in range(FOLDS):
        centres = k_means(v[fold != i], CENTROIDS)
        own = [whole[j] for j in np.flatnonzero(fold == i)]
        parts = [t[: int(1.4 * 2**k)] for t in own for k in range(2, LENGTHS) if len(t) > 1.4 * 2**k] + own
        for a in range(0, len(parts), 200):
            column = pa.array(parts[a : a + 200], pa.string())
            known = has_letter(column)
            near = (vectors(term_counts(column), idf) @ centres.T).max(axis=1)
            for k, x in zip(length_classes(column)[known].tolist(), near[known].tolist(), strict=True):
                found[k].append(x)
    floors = [MARGIN * float(np.quantile(x, QUANTILE)) if len(x) >= ENOUGH else None for x in found]
    last = 0.0  # of the next shorter class, where too few have a length
    for k, x in enumerate(floors):
        last = floors[k] = last if x is None else x
    return np.array(floors)


class Model:
    def __init__(self, labels: list[str], centres: np.ndarray, floors: np.ndarray, idf: np.ndarray):
        self.labels, self.centres, self.floors, self.idf = labels, centres, floors, idf


def fit(training: DataFrame, text_col: str = "text", label_col: str = "lang") -> Model:
    """Centroids from labelled rows; what reaches the driver is bounded by SAMPLE rows for each language."""
    training = training.select(F.col(text_col).alias("text"), F.col(label_col).alias("label")).where("text is not null and label is not null")
    found, n = document_frequencies(training, "text")
    idf = (np.log((1 + n) / (1 + found)) + 1).astype(np.float32)
    shared = training.sparkSession.sparkContext.broadcast(idf)

    def run(table: pa.Table) -> pa.Table:
        texts = table.column("text").combine_chunks()
        v = vectors(np.concatenate([term_counts(texts.slice(a, 200)) for a in range(0, len(texts), 200)]), shared.value)
        some = np.abs(v).sum(axis=1) > 0
        v = v[some]
        if not len(v):
            return pa.table({"label": pa.array([], pa.string()), "centre": pa.array([], pa.binary()), "lows": pa.array([], pa.list_(pa.float64()))})
        centres = k_means(v, CENTROIDS)
        near = v @ centres.T
        floors = held_out_floors(texts.filter(pa.array(some)), shared.value)
        lows = [(np.full(LENGTHS, REJECT * near[near.argmax(axis=1) == i, i].min(initial=1.0)) if floors is None else floors).tolist() for i in range(len(centres))]
        label = table.column("label")[0].as_py()
        return pa.table({"label": pa.array([label] * len(centres)), "centre": pa.array([c.astype(np.float32).tobytes() for c in centres], pa.binary()), "lows": pa.array(lows, pa.list_(pa.float64()))})

    rows = distinct_sample(training, SAMPLE).groupBy("label").applyInArrow(run, "label string, centre binary, lows array<double>").collect()
    rows = sorted(rows, key=lambda r: (r.label, bytes(r.centre)))
    centres = np.stack([np.frombuffer(r.centre, np.float32) for r in rows]) if rows else np.zeros((0, 1 << BITS), np.float32)
    return Model([r.label for r in rows], centres, np.array([r.lows for r in rows]).reshape(-1, LENGTHS), idf)


def distinct_sample(training: DataFrame, most: int) -> DataFrame:
    """(label, text): of each label the `most` distinct texts with the smallest hashes, all if there are fewer.

    A rate for each label, from about how many distinct texts it has, lets about
    three times as many pass (all of a label that has fewer), so copies cost a label
    nothing however many they are. Copies of one text share a hash and merge in each task.
    """
    hashed = training.withColumn("place", F.pmod(F.xxhash64("text"), F.lit(1 << 60)))
    counts = hashed.groupBy("label").agg(F.approx_count_distinct("place", 0.05).alias("n"))
    if counts.limit(FEW_LABELS + 1).count() <= FEW_LABELS:
        counts = F.broadcast(counts)
    rated = hashed.join(counts, "label").where(F.col("place") / (1 << 60) * F.col("n") < 3 * most)
    chosen = rated.groupBy("label", "place").agg(F.min("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("place"))
    return chosen.withColumn("rank", rank).where(F.col("rank") <= most).select("label", "text")


def predict(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds lang_pred, score (cosine, 0 to 1) and rejected."""
    names = ["lang_pred", "score", "rejected"]
    fields = [f for f in df.schema if f.name not in names]
    schema = T.StructType(fields + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        labels = np.array([*m.labels, UNKNOWN], object)
        for batch in _pieces(batches, text_col):
            n, column = batch.num_rows, batch.column(text_col)
            known = has_letter(column) & bool(len(m.labels))
            which, score, rejected = np.full(n, len(m.labels)), np.zeros(n), np.ones(n, bool)
            if known.any():
                near = np.round((vectors(term_counts(column), m.idf) @ m.centres.T).astype(np.float64), 6)
                best = near.argmax(axis=1)
                top = near[np.arange(n), best]
                which = np.where(known, best, which)
                score = np.where(known, np.clip(top, 0, 1), 0.0)
                rejected = ~known | (top < m.floors[best, length_classes(column)])
            made = [pa.array(labels[which], pa.string()), pa.array(score), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in fields] + made, names=[f.name for f in fields] + names)

    return df.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id", modulus: int = 4, remainder: int = 2) -> Column:
    """Whether crc32 of the id as text leaves `remainder`."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))
