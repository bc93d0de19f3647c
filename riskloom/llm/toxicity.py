"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the hashed n-grams of `WIDTHS` bytes that a text has (each once).
Their log-count ratios come from all training rows. A logistic regression on the
scaled features is fitted on a bounded sample of training rows, `SAMPLE`
distinct texts of each label (all, if fewer), by L-BFGS; both labels weigh the same in all.

Null and empty texts have no features and get the score of the intercept. Rows
whose label isn't 0 or 1 are left out of training; without both labels among the
training rows every score is the share of label 1 (0.5 without any). Extra columns
pass through; columns with the names made here are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcore as C
from .language_id import distinct_sample
from .ngrams import buckets, letters_only
from .tables import written

BITS, WIDTHS = 19, (4, 5)
SAMPLE = 3000
#: Weight of the squared length of the scaled weights, and added to each n-gram's count.
PENALTY, SMOOTH = 1e-2, 1.0
CHUNK = 1 << 13


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each text, laid end to end, and n + 1 bounds."""
    flat, bounds = letters_only(column)
    parts = [buckets(flat, bounds, w, BITS) for w in WIDTHS]
    n = len(bounds) - 1
    edges = [np.searchsorted(text, np.arange(n + 1)) for _, text in parts]
    seen = np.zeros(1 << BITS, np.int32)
    out = []
    for i in range(n):
        ids = np.concatenate([b[e[i] : e[i + 1]] for (b, _), e in zip(parts, edges, strict=True)])
        seen[ids] = np.arange(len(ids), dtype=np.int32)
        out.append(ids[seen[ids] == np.arange(len(ids), dtype=np.int32)])
    return np.concatenate(out or [np.zeros(0, np.int64)]), np.append(0, np.cumsum([len(x) for x in out])).astype(np.int64)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the values between bounds."""
    full = bounds[1:] > bounds[:-1]
    out = np.zeros(len(full))
    if full.any():
        out[full] = np.add.reduceat(values, bounds[:-1][full], dtype=np.float64)
    return out


def _pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        yield from C.slices(whole, column, 1 << 20)


def log_count_ratios(training: DataFrame) -> tuple[np.ndarray, dict[int, int]]:
    """Over all rows (text, label): log of the smoothed share of each n-gram in label 1 over that in label 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), np.int64)
        rows = np.zeros(2, np.int64)
        for batch in _pieces(batches, "text"):
            ids, bounds = features(batch.column("text"))
            label = batch.column("label").to_numpy(zero_copy_only=False)
            rows += np.bincount(label, minlength=2)
            owner = np.repeat(label, np.diff(bounds))
            for y in (0, 1):
                total[y] += np.bincount(ids[owner == y], minlength=1 << BITS)
        at = range(0, 1 << BITS, CHUNK)
        cells = [total[:, a : a + CHUNK].tobytes() for a in at]
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(cells)), -1]), pa.array([*cells, rows.tobytes()], pa.binary())], names=["chunk", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"chunk": table.column("chunk")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    counted = training.mapInArrow(count, "chunk long, counts binary").groupBy("chunk").applyInArrow(add, "chunk long, counts binary")
    cells = {r.chunk: np.frombuffer(r.counts, np.int64) for r in counted.collect()}
    rows = cells.pop(-1, np.zeros(2, np.int64))
    if not cells:
        return np.zeros(1 << BITS), {0: 0, 1: 0}
    both = np.concatenate([cells[c].reshape(2, -1) for c in sorted(cells)], axis=1) + SMOOTH
    share = both / (rows[:, None] + 2 * SMOOTH)
    return np.log(share[1] / share[0]), {0: int(rows[0]), 1: int(rows[1])}


def minimise(f, x: np.ndarray, rounds: int = 60, keep: int = 8) -> np.ndarray:
    """L-BFGS with backtracking; f gives a value and its gradient."""
    value, slope = f(x)
    history: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        step, scales = -slope, []
        for s, y, r in reversed(history):
            a = r * (s @ step)
            scales.append(a)
            step = step - a * y
        if history:
            s, y, r = history[-1]
            step = step / (r * (y @ y))
        for (s, y, r), a in zip(history, reversed(scales), strict=True):
            step = step + (a - r * (y @ step)) * s
        rate, gain = (1.0 if history else 1.0 / max(1.0, np.abs(slope).sum())), slope @ step
        while True:
            new_value, new_slope = f(x + rate * step)
            if new_value <= value + 1e-4 * rate * gain or rate < 1e-10:
                break
            rate /= 2
        s, y = rate * step, new_slope - slope
        if s @ y > 1e-12:
            history = [*history, (s, y, 1 / (s @ y))][-keep:]
        done = abs(value - new_value) < 1e-7 * max(1.0, abs(value))
        x, value, slope = x + s, new_value, new_slope
        if done:
            break
    return x


def _fit_sample(ids: np.ndarray, bounds: np.ndarray, label: np.ndarray, weight: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the scaled features that the sample has, and the intercept."""
    seen = np.zeros(1 << BITS, bool)
    seen[ids] = True
    used = np.flatnonzero(seen)
    ids = (np.cumsum(seen, dtype=np.int32) - 1)[ids]
    scale = ratio[used].astype(np.float32)
    value, owner = scale[ids], np.repeat(np.arange(len(label), dtype=np.int32), np.diff(bounds))
    sign = 2.0 * label - 1

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        z = sign * (sums(value * x[:-1].astype(np.float32)[ids], bounds) + x[-1])
        p = 0.5 * (1 + np.tanh(-z / 2))
        total = (weight * np.logaddexp(0, -z)).sum() + PENALTY / 2 * weight.sum() * (x[:-1] @ x[:-1])
        pull = -weight * p * sign
        slope = np.bincount(ids, value * pull.astype(np.float32)[owner], minlength=len(used)) + PENALTY * weight.sum() * x[:-1]
        return float(total), np.append(slope, pull.sum())

    x = minimise(loss, np.zeros(len(used) + 1))
    weights = np.zeros(1 << BITS)
    weights[used] = x[:-1] * scale
    return weights, float(x[-1])


class Model:
    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept


def fit(training: DataFrame, text_col: str = "text", label_col: str = "toxic") -> Model:
    training = training.select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and text is not null")
    training = written(training, "training")  # it is read twice, and mostly the result of a join
    ratio, rows = log_count_ratios(training)
    if not rows[0] or not rows[1]:
        share = (rows[1] + 0.5) / (rows[0] + rows[1] + 1)
        return Model(np.zeros(1 << BITS), float(np.log(share / (1 - share))) if rows[0] + rows[1] else 0.0)
    sample = distinct_sample(training, SAMPLE)

    def vectorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, "text"):
            ids, bounds = features(batch.column("text"))
            rows = [ids[a:b].astype(np.int32).tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column("label")], names=["ids", "label"])

    shared = training.sparkSession.sparkContext.broadcast(ratio.astype(np.float32))

    def solve(table: pa.Table) -> pa.Table:
        raw = table.column("ids").to_pylist()
        bounds = np.append(0, np.cumsum([len(x) // 4 for x in raw])).astype(np.int64)
        label = table.column("label").to_numpy().astype(np.int64)
        n = np.bincount(label, minlength=2)
        weight = (len(label) / np.maximum(n, 1))[label]
        weights, intercept = _fit_sample(np.frombuffer(b"".join(raw), np.int32), bounds, label, weight / weight.mean(), shared.value.astype(np.float64))
        at = np.flatnonzero(np.abs(weights) > 1e-6)
        return pa.table({"at": pa.array([at.astype(np.int32).tobytes()], pa.binary()), "weight": pa.array([weights[at].astype(np.float32).tobytes()], pa.binary()), "intercept": [intercept]})

    solved = sample.mapInArrow(vectorise, "ids binary, label int").withColumn("one", F.lit(1)).groupBy("one").applyInArrow(solve, "at binary, weight binary, intercept double").collect()
    weights = np.zeros(1 << BITS, np.float32)
    if not solved:
        return Model(weights, 0.0)
    weights[np.frombuffer(solved[0]["at"], np.int32)] = np.frombuffer(solved[0].weight, np.float32)
    return Model(weights, solved[0].intercept)


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if score >= 0.5)."""
    names = ["score", "predicted"]
    fields = [f for f in df.schema if f.name not in names]
    schema = T.StructType(fields + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in _pieces(batches, text_col):
            ids, bounds = features(batch.column(text_col))
            z = sums(m.weights[ids], bounds) + m.intercept
            p = 0.5 * (1 + np.tanh(z / 2))
            made = [pa.array(p), pa.array((p >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in fields] + made, names=[f.name for f in fields] + names)

    return df.mapInArrow(run, schema)
