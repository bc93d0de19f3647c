"""Robustness audits over the scores table: CV summary, bootstrap, permutation, perturbation.

Every audit is a long table keyed by (model, iteration | feature, repeat |
scenario) fed to the grouped metrics of :mod:`riskloom.operators.metrics`;
no per-iteration Python loop touches data.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.config import (
    CV_MODERATE_MAX_PCT,
    CV_STABLE_MAX_PCT,
    HIGHER_IS_BETTER,
    RISK_BANDS,
    ROW_ID,
    SENSITIVITY_INSENSITIVE_MAX,
    SENSITIVITY_MIN_BASELINE_ABS,
    SENSITIVITY_OVERREACTIVE_MIN,
    LinearScorer,
)
from riskloom.functions.expressions import clip_probability, risk_band, sigmoid
from riskloom.functions.md5_rows import Texts, gathered
from riskloom.operators import metrics as M

CV_METRICS = ["roc_auc", "brier", "log_loss", "calibration_slope_error", "calibration_intercept_abs", "accuracy", "precision", "recall",
              "specificity", "f1", "false_positive_rate", "false_negative_rate", "positive_prediction_rate", "positive_prevalence",
              "tn_share", "fp_share", "fn_share", "tp_share", "mean_risk_score", "expected_cost", "expected_cost_per_sample", "threshold"]
BOOTSTRAP_METRICS = ["roc_auc", "brier", "log_loss", "recall", "precision", "f1", "false_negative_rate",
                     "false_positive_rate", "expected_cost", "calibration_slope_error", "calibration_intercept_abs"]
#: Bins of a resample for each unit of the logit.
BOOTSTRAP_BINS = 128
PERMUTATION_METRICS = ["roc_auc", "brier", "log_loss", "recall", "expected_cost"]


def unpivot(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], name: str = "metric_name",
            value: str = "value") -> DataFrame:
    arr = F.array(*[F.struct(F.lit(m).alias(name), F.col(m).cast("double").alias(value)) for m in metrics])
    return df.select(*keys, F.explode(arr).alias("_u")).select(*keys, f"_u.{name}", f"_u.{value}")


# --------------------------------------------------------------- cv summary
def cv_summary(fold_metrics: DataFrame, metrics: Sequence[str] = CV_METRICS, fold_col: str = "fold_id") -> DataFrame:
    """Per (model, metric) over folds: n, mean, pop std, variation %, min, max, max fold-to-fold jump, label."""
    long = unpivot(fold_metrics, ["model_name", fold_col], metrics).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    w = Window.partitionBy("model_name", "metric_name").orderBy(fold_col)  # <= #folds rows per group
    long = long.withColumn("jump", F.abs(F.col("value") - F.lag("value").over(w)))
    agg = long.groupBy("model_name", "metric_name").agg(
        F.count(F.lit(1)).alias("folds"), F.avg("value").alias("m"), F.stddev_pop("value").alias("s"),
        F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        F.coalesce(F.max("jump"), F.lit(0.0)).alias("max_jump"))
    var = F.when(F.abs(F.col("m")) <= 1e-8, F.lit(0.0)).otherwise(F.abs(F.col("s") / F.col("m")) * 100.0)
    return agg.select(
        "model_name", "metric_name", "folds", F.round("m", 8).alias("mean_value"), F.round("s", 8).alias("std_value"),
        F.round(var, 6).alias("variation_pct_of_mean"), F.round("min_value", 8).alias("min_value"),
        F.round("max_value", 8).alias("max_value"), F.round("max_jump", 8).alias("max_fold_jump"),
        F.when(var <= CV_STABLE_MAX_PCT, "stable").when(var <= CV_MODERATE_MAX_PCT, "moderate").otherwise("volatile").alias("robustness_label"),
    )


# ---------------------------------------------------------------- bootstrap
# Cumulative Poisson(1) probabilities P(X <= k), k = 0..(len-1)
def _poisson1_cdf(kmax: int = 16) -> list[float]:
    acc, out = 0.0, []
    for k in range(kmax + 1):
        acc += math.exp(-1.0) / math.factorial(k)
        out.append(acc)
    return out


POISSON1_CDF = _poisson1_cdf()


#: Weight of a draw by its first 16 bits; 255 where one of the cumulative probabilities lies within.
_LIMITS = np.array(POISSON1_CDF) * 2.0**48
_WEIGHTS = np.searchsorted(_LIMITS, np.arange(1 << 16) * 2.0**32, "right").astype(np.uint8)
_WEIGHTS[_WEIGHTS != np.searchsorted(_LIMITS, np.arange(1, (1 << 16) + 1) * 2.0**32 - 1, "right")] = 255


def poisson_weights(keys: Sequence, iterations: int, seed: int = 42) -> np.ndarray:
    """Poisson(1) weights (keys x iterations): the inverse CDF at the first 48 bits of md5('<seed>:boot:<iteration>:<key>')."""
    texts = Texts([str(k).encode() for k in keys])
    out = np.empty((iterations, len(keys)), np.uint8)
    for i in range(iterations):
        draws = texts.first8(f"{seed}:boot:{i + 1}:".encode())
        own = out[i] = _WEIGHTS[draws >> np.uint64(48)]
        for j in np.flatnonzero(own == 255):
            out[i, j] = np.searchsorted(_LIMITS, float(int(draws[j]) >> 16), "right")
    return np.ascontiguousarray(out.T)


class _Resamples:
    """Sums of all resamples over one model's scores in ascending order of p, a batch at a time."""

    def __init__(self, iterations: int):
        self.zero = np.zeros(iterations)
        self.counts = np.zeros((8, iterations))  # tn, fp, fn, tp, squared errors, log-loss, negatives, positives
        self.rank, self.below = self.zero.copy(), self.zero.copy()
        self.tie: tuple[float, np.ndarray, np.ndarray] | None = None
        self.bins: list[tuple[np.ndarray, np.ndarray]] = []
        self.pos_x = self.zero.copy()

    def _ranked(self, pos: np.ndarray, neg: np.ndarray) -> None:
        half = np.cumsum(neg, axis=0)
        total = half[-1].copy() if len(half) else self.zero
        half -= 0.5 * neg
        self.rank += np.einsum("ij,ij->j", pos, half) + self.below * pos.sum(axis=0)
        self.below = self.below + total

    def add(self, y: np.ndarray, hit: np.ndarray, clipped: np.ndarray, w: np.ndarray) -> None:
        """`hit` is 1 where the score reaches the threshold, 0 where not, -1 without a score; such a row counts for the other metrics, as in the payload."""
        w = w.astype(np.float64)
        own = y == 1
        x = np.log(clipped / (1 - clipped))
        each = [~own & (hit == 0), ~own & (hit == 1), own & (hit == 0), own & (hit == 1), (clipped - y) ** 2, -(y * np.log(clipped) + (1 - y) * np.log(1 - clipped)), ~own, own, y * x]
        sums = np.stack([k.astype(np.float64) for k in each]) @ w
        self.counts += sums[:8]
        self.pos_x += sums[8]
        place = np.floor(x * BOOTSTRAP_BINS).astype(np.int64)
        starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        gap = x - (place + 0.5) / BOOTSTRAP_BINS
        powers = np.stack([gap**j for j in range(5)])
        # scores come in order, so the rows of a bin are neighbours
        self.bins.append((place[starts], np.stack([powers[:, a:b] @ w[a:b] for a, b in zip(starts, np.append(starts[1:], len(x)), strict=True)], axis=1)))
        # groups of equal scores; the last one may go on in the next batch
        starts = np.flatnonzero(np.append(True, clipped[1:] != clipped[:-1]))
        pos, neg = (w * k[:, None] for k in (y, 1 - y))
        if len(starts) < len(w):
            pos, neg = (np.add.reduceat(k, starts, axis=0) for k in (pos, neg))
        if self.tie is not None:
            if self.tie[0] == clipped[0]:
                pos[0] += self.tie[1]
                neg[0] += self.tie[2]
            else:
                self._ranked(self.tie[1][None], self.tie[2][None])
        self._ranked(pos[:-1], neg[:-1])
        self.tie = (float(clipped[-1]), pos[-1].copy(), neg[-1].copy())

    def rows(self, model: str, part: int) -> pa.RecordBatch:
        if self.tie is not None:
            self._ranked(self.tie[1][None], self.tie[2][None])
        place, powers = np.concatenate([b[0] for b in self.bins]), np.concatenate([b[1] for b in self.bins], axis=1)
        # a bin that went on in the next batch is one
        starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        place, powers = place[starts], np.add.reduceat(powers, starts, axis=1)
        n = len(self.zero)
        sums = np.vstack([self.counts, self.rank, self.pos_x])
        return pa.RecordBatch.from_arrays(
            [pa.array([model] * n), pa.array(np.arange(1, n + 1, dtype=np.int32)), pa.array([part] * n, pa.int32()), pa.array([sums[:, k].tobytes() for k in range(n)], pa.binary()),
             pa.array([place.tobytes()] * n, pa.binary()), pa.array([np.ascontiguousarray(powers[:, :, k]).tobytes() for k in range(n)], pa.binary())],
            names=["model_name", "iteration", "part", "sums", "bins", "powers"])


def _resample_metrics(table: pa.Table, fn_cost: float, fp_cost: float) -> pa.Table:
    """The metrics of one resample from its parts, in the order of scores."""
    table = table.sort_by("part")
    sums = np.stack([np.frombuffer(x.as_buffer(), np.float64) for x in table.column("sums")])
    (tn, fp, fn, tp, error, loss), (negatives, positives) = sums[:, :6].sum(axis=0), sums[:, 6:8].T
    rank, pos_x = sums[:, 8], sums[:, 9].sum()
    before = np.cumsum(negatives) - negatives
    pos, neg = positives.sum(), negatives.sum()
    n = pos + neg
    share = lambda a, b: float(a / b) if b else 0.0
    precision, recall = share(tp, tp + fp), share(tp, tp + fn)
    a, b = 0.0, 1.0
    if pos and neg:
        place = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("bins")])
        powers = np.concatenate([np.frombuffer(x.as_buffer(), np.float64).reshape(5, -1) for x in table.column("powers")], axis=1)
        a, b, _ = M.calibration_of_bins(place, powers, float(pos), float(pos_x), BOOTSTRAP_BINS)
    values = {
        "roc_auc": float((rank.sum() + (positives * before).sum()) / (pos * neg)) if pos and neg else None, "brier": share(error, n), "log_loss": share(loss, n),
        "recall": recall, "precision": precision, "f1": share(2 * precision * recall, precision + recall), "false_negative_rate": share(fn, fn + tp),
        "false_positive_rate": share(fp, fp + tn), "expected_cost": float(fn * fn_cost + fp * fp_cost), "calibration_slope_error": abs(b - 1), "calibration_intercept_abs": abs(a),
    }
    return pa.table({"model_name": table.column("model_name").slice(0, 1), "iteration": table.column("iteration").slice(0, 1), **{k: pa.array([values[k]], pa.float64()) for k in BOOTSTRAP_METRICS}})


def bootstrap_metrics(scores: DataFrame, iterations: int, threshold: float, fn_cost: float = 1.0, fp_cost: float = 1.0, seed: int = 42, key: str = ROW_ID) -> DataFrame:
    """(model_name, iteration, metrics) of Poisson resamples, the same draws for every model.

    Scores are dealt into ranges of (model, clipped p), so equal ones meet, and only then drawn: neither weights nor rows are moved
    or repeated for a resample. Each task returns, for each resample, sums and bins of the logit whose number doesn't depend on the rows.
    """
    spark = scores.sparkSession
    q = F.round(clip_probability(F.col("p")), M.ROUND_P)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = scores.select("model_name", F.col(key).alias("key"), F.col("y").cast("int").alias("y"), F.coalesce((F.col("p") >= threshold).cast("int"), F.lit(-1)).alias("hit"), q.alias("q"))
    ranged = rows.repartitionByRange(parts, "model_name", "q").sortWithinPartitions("model_name", "q")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, model, own = TaskContext.get().partitionId(), None, None
        for whole in gathered(batches):
            # hashes go through many texts at a time, sums through as many rows as a core's cache takes
            weights = poisson_weights(whole.column("key").to_pylist(), iterations, seed)
            for at in range(0, whole.num_rows, 1000):
                batch, w = whole.slice(at, 1000), weights[at : at + 1000]
                names = batch.column("model_name")
                y, hit, q = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "hit", "q"))
                for name in pc.unique(names).to_pylist():
                    mine = pc.equal(names, name).to_numpy(zero_copy_only=False)
                    if name != model:
                        if own is not None:
                            yield own.rows(model, part)
                        model, own = name, _Resamples(iterations)
                    own.add(y[mine], hit[mine], q[mine], w[mine])
        if own is not None:
            yield own.rows(model, part)

    sums = ranged.mapInArrow(add, "model_name string, iteration int, part int, sums binary, bins binary, powers binary")
    schema = "model_name string, iteration int, " + ", ".join(f"{m} double" for m in BOOTSTRAP_METRICS)
    return sums.groupBy("model_name", "iteration").applyInArrow(lambda t: _resample_metrics(t, fn_cost, fp_cost), schema)


def _percentile_linear(col: str, q: float) -> Column:
    return F.percentile(F.col(col), F.lit(q))


def bootstrap_ci(scores: DataFrame, iterations: int = 250, threshold: float = 0.5, fn_cost: float = 1.0,
                 fp_cost: float = 1.0, confidence: float = 0.95, seed: int = 42,
                 metrics: Sequence[str] = BOOTSTRAP_METRICS) -> DataFrame:
    """Percentile CIs of 11 metrics per model from Poisson-weighted resamples of the scores."""
    keys = ["model_name", "iteration"]
    per_iter = bootstrap_metrics(scores, iterations, threshold, fn_cost, fp_cost, seed)
    base = M.metric_payload(scores, ["model_name"], threshold, fn_cost, fp_cost)
    base_long = unpivot(base, ["model_name"], metrics, value="baseline")
    long = unpivot(per_iter, keys, metrics).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    alpha = max(0.0, min(1.0, 1.0 - confidence))
    agg = long.groupBy("model_name", "metric_name").agg(
        F.avg("value").alias("mean_value"), _percentile_linear("value", alpha / 2).alias("lo"),
        _percentile_linear("value", 1 - alpha / 2).alias("hi"), F.count(F.lit(1)).alias("valid_iterations"))
    out = base_long.join(agg, ["model_name", "metric_name"], "left")
    return out.select(
        "model_name", "metric_name", F.round("baseline", 7).alias("baseline"), F.round("mean_value", 7).alias("mean_value"),
        F.round("lo", 7).alias("ci_lower"), F.round("hi", 7).alias("ci_upper"), F.round(F.col("hi") - F.col("lo"), 7).alias("ci_width"),
        F.coalesce("valid_iterations", F.lit(0)).alias("valid_iterations"))


# ----------------------------------------------------- permutation importance
def linear_score_from(scorer: LinearScorer, value_of) -> Column:
    z = F.lit(float(scorer.intercept))
    for f, wgt in scorer.weights:
        z = z + F.lit(float(wgt)) * value_of(f)
    return F.round(sigmoid(z), scorer.round_digits)


#: Cells of a hash order that are counted, ranks that are paired at a time, and permuted values that are kept at a time.
PERMUTATION_CELLS, PERMUTATION_RANKS, PERMUTED_AT_ONCE = 1 << 10, 1 << 17, 1 << 24
_ORDERS = ("perm_a", "perm_b")


def _key_texts(keys: pa.Array) -> Texts:
    # as concat_ws joins them: a null key leaves nothing behind the repeat
    return Texts([b"" if k is None else b":" + k.encode() for k in keys.to_pylist()])


def permutation_counts(rows: DataFrame, features: Sequence[str], repeats: int, seed: int = 42, key: str = ROW_ID) -> np.ndarray:
    """Rows in each cell of both orders of each (feature, repeat): orders x features x repeats x cells, whatever the rows."""
    shape = (len(_ORDERS), len(features), repeats, PERMUTATION_CELLS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.int64)
        for batch in gathered(batches):
            texts = _key_texts(batch.column("key"))
            for o, order in enumerate(_ORDERS):
                for i, f in enumerate(features):
                    for r in range(repeats):
                        total[o, i, r] += np.bincount(texts.first8(f"{seed}:{order}:{f}:{r + 1}".encode()) >> np.uint64(54), minlength=PERMUTATION_CELLS)
        each = total.reshape(-1, PERMUTATION_CELLS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(each), dtype=np.int32)), pa.array([x.tobytes() for x in each], pa.binary())], names=["place", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in table.column("counts"))
        return pa.table({"place": table.column("place").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(shape, np.int64)
    schema = "place int, counts binary"
    for r in rows.select(F.col(key).cast("string").alias("key")).mapInArrow(run, schema).groupBy("place").applyInArrow(add, schema).collect():
        out.reshape(-1, PERMUTATION_CELLS)[r.place] = np.frombuffer(r.counts, np.int64)
    return out


def permuted_table(rows: DataFrame, features: Sequence[str], repeats: int, seed: int = 42, key: str = ROW_ID, kept: Callable[[str], Sequence[Column]] | None = None,
                   only: Sequence[int] | None = None, counts: np.ndarray | None = None) -> DataFrame:
    """(feature_name, repeat, kept columns, permuted_value): for each (feature, repeat) all rows, with the feature value of another row.

    Row with rank ``r`` under order A receives the value of the row with rank ``r`` under an independent order B, both
    by md5 of (feature, repeat, key) — a uniform random permutation. The cells of the orders' counts give the rank that each
    cell begins with, so rows and values go once, packed, to the task that pairs their range of ranks; cells that lie in two ranges go to both.
    `kept` are the columns that go along with a feature (all, if not given), `only` the repeats that are wanted.
    """
    features, numbers = list(features), list(range(1, repeats + 1) if only is None else only)
    counts = permutation_counts(rows, features, repeats, seed, key) if counts is None else counts
    starts = np.cumsum(counts, axis=-1) - counts
    first, last = starts // PERMUTATION_RANKS, (starts + np.maximum(counts, 1) - 1) // PERMUTATION_RANKS
    own = [[F.col(f"`{c}`") for c in rows.columns] if kept is None else list(kept(f)) for f in features]
    names = rows.select(*own[0]).columns
    sent = rows.select(F.col(key).cast("string").alias("key"), *[c.alias(f"k{i}_{j}") for i, cs in enumerate(own) for j, c in enumerate(cs)], *[F.col(f).cast("double").alias(f"v{i}") for i, f in enumerate(features)])
    shared = rows.sparkSession.sparkContext.broadcast((starts, first, last))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, first, last = shared.value
        for batch in gathered(batches):
            texts = _key_texts(batch.column("key"))
            for i, f in enumerate(features):
                payloads = [[batch.column(f"k{i}_{j}") for j in range(len(names))], [batch.column(f"v{i}")]]
                for r in numbers:
                    out: list[tuple[int, int, int, int, bytes]] = []
                    for o, order in enumerate(_ORDERS):
                        hashes = texts.first8(f"{seed}:{order}:{f}:{r}".encode())
                        at = np.argsort(hashes)
                        cell = (hashes[at] >> np.uint64(54)).astype(np.int64)
                        low, high = first[o, i, r - 1][cell], last[o, i, r - 1][cell]
                        packed = pa.RecordBatch.from_arrays([pa.array(hashes), *payloads[o]], names=["h", *[f"c{j}" for j in range(len(payloads[o]))]]).take(pa.array(at))
                        for block in range(int(low[0]), int(high[-1]) + 1) if len(at) else ():
                            a, b = np.searchsorted(high, block), np.searchsorted(low, block, "right")
                            if a < b:
                                sink = pa.BufferOutputStream()
                                with pa.ipc.new_stream(sink, packed.schema) as writer:
                                    writer.write_batch(packed.slice(a, b - a))
                                out.append((i, r, block, o, sink.getvalue().to_pybytes()))
                    yield pa.RecordBatch.from_arrays([*[pa.array([x[k] for x in out], pa.int32()) for k in range(4)], pa.array([x[4] for x in out], pa.binary())], names=["feature", "repeat", "block", "side", "rows"])

    def paired(table: pa.Table) -> pa.Table:
        starts, _, _ = shared.value
        i, r, block = (table.column(c)[0].as_py() for c in ("feature", "repeat", "block"))
        sides = []
        for o in range(len(_ORDERS)):
            own = table.filter(pc.equal(table.column("side"), o)).column("rows")
            whole = pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in own])
            hashes = whole.column("h").to_numpy()
            at = np.argsort(hashes, kind="stable")
            # the group has whole cells, so the first one tells the rank
            skip = block * PERMUTATION_RANKS - int(starts[o, i, r - 1, int(hashes[at[0]] >> np.uint64(54))])
            sides.append(whole.take(pa.array(at[skip : skip + PERMUTATION_RANKS])).drop_columns("h").combine_chunks())
        n = sides[0].num_rows
        columns = [pa.array([features[i]] * n, pa.string()), pa.array(np.full(n, r, np.int32)), *sides[0].columns, sides[1].column(0)]
        return pa.table(columns, names=["feature_name", "repeat", *names, "permuted_value"])

    moved = sent.mapInArrow(send, "feature int, repeat int, block int, side int, rows binary")
    schema = T.StructType([T.StructField("feature_name", T.StringType()), T.StructField("repeat", T.IntegerType()), *rows.select(*own[0]).schema.fields, T.StructField("permuted_value", T.DoubleType())])
    return moved.groupBy("feature", "repeat", "block").applyInArrow(paired, schema)


def permutation_importance(rows: DataFrame, scorer: LinearScorer, repeats: int = 12, threshold: float = 0.5,
                           fn_cost: float = 1.0, fp_cost: float = 1.0, seed: int = 42, y: str = "Outcome",
                           groups: dict[str, str] | None = None) -> DataFrame:
    """Mean change of each metric when a feature's values are permuted, over the repeats.

    Repeats are scored a few at a time: what one lot has moved and kept is let go before the next, so disk doesn't grow with the repeats.
    """
    spark, feats = rows.sparkSession, list(scorer.features())
    base = rows.select(F.lit(scorer.name).alias("model_name"), F.col(y).alias("y"),
                       linear_score_from(scorer, lambda f: F.col(f)).alias("p"))
    read = rows.select(ROW_ID, F.col(y).alias("y"), *feats)
    counts = permutation_counts(read, feats, repeats, seed)
    n = int(counts[0, 0, 0].sum()) if feats and repeats else 0
    weight = {f: float(w) for f, w in scorer.weights}

    def without(f: str) -> list[Column]:
        z = F.lit(float(scorer.intercept))
        for g in feats:
            z = z if g == f else z + F.lit(weight[g]) * F.col(g)
        return [F.col("y"), z.alias("rest")]

    at_once = max(1, PERMUTED_AT_ONCE // max(1, n * len(feats)))
    own = F.coalesce(*[F.when(F.col("feature_name") == f, F.lit(weight[f])) for f in feats])
    p_perm = F.round(sigmoid(F.col("rest") + own * F.col("permuted_value")), scorer.round_digits)
    keys = ["model_name", "feature_name", "repeat"]
    found, schema = [], None
    for start in range(1, repeats + 1, at_once):
        some = range(start, min(start + at_once, repeats + 1))
        perm = permuted_table(read, feats, repeats, seed, kept=without, only=some, counts=counts)
        ps = perm.select(F.lit(scorer.name).alias("model_name"), "feature_name", "repeat", "y", p_perm.alias("p")).persist(StorageLevel.DISK_ONLY)
        try:
            own_metrics = M.metric_payload(ps, keys, threshold, fn_cost, fp_cost, calibration=False)
            schema = own_metrics.schema
            found += own_metrics.collect()  # a row for each (feature, repeat)
        finally:
            ps.unpersist(True)
        if at_once < repeats:
            # shuffle files go with the objects of their plans
            del perm, ps, own_metrics
            gc.collect()
            spark.sparkContext._jvm.System.gc()
    m = spark.createDataFrame(found, schema)
    b = M.metric_payload(base, ["model_name"], threshold, fn_cost, fp_cost, calibration=False)
    long = unpivot(m, keys, PERMUTATION_METRICS).join(unpivot(b, ["model_name"], PERMUTATION_METRICS, value="baseline"),
                                                      ["model_name", "metric_name"])
    delta = F.when(F.col("metric_name").isin(*HIGHER_IS_BETTER), F.col("baseline") - F.col("value")).otherwise(
        F.col("value") - F.col("baseline"))
    agg = long.withColumn("delta", delta).groupBy("model_name", "feature_name", "metric_name").agg(
        F.avg("delta").alias("mean_delta"), F.stddev_samp("delta").alias("std_delta"), F.count(F.lit(1)).alias("repeats"))
    grp = groups or {}
    group_col = F.coalesce(F.element_at(F.create_map(*[x for k, v in grp.items() for x in (F.lit(k), F.lit(v))]), F.col("feature_name")),
                           F.lit("ungrouped")) if grp else F.lit("ungrouped")
    return agg.select(
        "model_name", "feature_name", group_col.alias("feature_group"), "metric_name",
        F.round("mean_delta", 8).alias("importance_mean"), F.round(F.coalesce(F.nanvl("std_delta", F.lit(0.0)), F.lit(0.0)), 8).alias("importance_std"),
        "repeats", (F.round("mean_delta", 8) > 0).alias("helps_model"))


# ----------------------------------------------------------- perturbation
GRID = 2**12


def _medians(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Exact median per group of values in [0, 1], rounded to 9 digits.

    Values are collapsed to cells, cells to a fixed grid; the grid cells that hold
    the two middle ranks are found first, and only their values are ordered.
    """
    keys = list(keys)
    v = F.round(value, 9)
    cells = df.groupBy(*keys, v.alias("v")).agg(F.count(F.lit(1)).alias("c")).withColumn("g", F.floor(F.col("v") * GRID).cast("int"))
    grid = cells.groupBy(*keys, "g").agg(F.sum("c").alias("gc"))
    w = Window.partitionBy(*keys)
    grid = grid.withColumn("off", F.sum("gc").over(w.orderBy("g").rowsBetween(Window.unboundedPreceding, 0)) - F.col("gc")).withColumn("n", F.sum("gc").over(w))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    inside = lambda r, a, b: (r >= a) & (r < b)
    wanted = grid.where(inside(low, F.col("off"), F.col("off") + F.col("gc")) | inside(high, F.col("off"), F.col("off") + F.col("gc")))
    few = cells.join(wanted.select(*keys, "g", "off", "n"), [*keys, "g"])
    ranked = few.withColumn("end", F.col("off") + F.sum("c").over(Window.partitionBy(*keys, "g").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    start = F.col("end") - F.col("c")
    pick = lambda r: F.max(F.when(inside(r, start, F.col("end")), F.col("v")))
    return ranked.groupBy(*keys).agg(((pick(low) + pick(high)) / 2).alias("median_abs_probability_delta"))


def perturbation_audit(sample: DataFrame, scorer: LinearScorer, percents: Sequence[float], threshold: float,
                       bands=RISK_BANDS, key: str = ROW_ID) -> DataFrame:
    """Per (feature, pct, direction): probability deltas, sensitivity ratios, flip and band-change rates.

    ``sample`` is any number of rows, usually a whole split (``sample_n`` makes a
    smaller one). The scenario grid, configured and small, is a generator over
    the rows; probability deltas are collapsed to (scenario, delta rounded to 9
    digits) before their exact median is taken by ranks.
    """
    feats = scorer.features()
    ends = sample.agg(*[F.min(f).alias(f"_min_{f}") for f in feats], *[F.max(f).alias(f"_max_{f}") for f in feats]).head()
    s = sample.select(key, *feats, *[F.lit(ends[c]).alias(c) for c in ends.asDict()])
    scen = F.array(*[F.struct(F.lit(f).alias("feature_name"), F.lit(float(pct)).alias("perturbation_pct"), F.lit(d).alias("direction"),
                              F.lit(float(1 - pct if d == "down" else 1 + pct)).alias("mult"))
                     for f in feats for pct in percents for d in ("down", "up")])
    x = s.withColumn("sc", F.explode(scen)).select("*", "sc.*").drop("sc")
    cur = F.coalesce(*[F.when(F.col("feature_name") == f, F.col(f)) for f in feats])
    lo = F.coalesce(*[F.when(F.col("feature_name") == f, F.col(f"_min_{f}")) for f in feats])
    hi = F.coalesce(*[F.when(F.col("feature_name") == f, F.col(f"_max_{f}")) for f in feats])
    x = x.withColumn("_cur", cur).withColumn("_new", F.least(F.greatest(F.col("_cur") * F.col("mult"), lo), hi))
    x = x.withColumn("rel_change", F.abs(F.col("_new") - F.col("_cur")) / F.greatest(F.abs(F.col("_cur")), F.lit(SENSITIVITY_MIN_BASELINE_ABS)))
    p0 = linear_score_from(scorer, lambda f: F.col(f))
    p1 = linear_score_from(scorer, lambda f: F.when(F.col("feature_name") == f, F.col("_new")).otherwise(F.col(f)))
    x = x.withColumn("p0", p0).withColumn("p1", p1).filter(F.col("rel_change") > 0)
    x = x.withColumn("dp", F.abs(F.col("p1") - F.col("p0"))).withColumn("ratio", F.col("dp") / F.col("rel_change"))
    flip = ((F.col("p0") >= threshold) != (F.col("p1") >= threshold)).cast("double")
    band_change = (F.coalesce(risk_band("p0", bands), F.lit("")) != F.coalesce(risk_band("p1", bands), F.lit(""))).cast("double") if bands else F.lit(None).cast("double")
    agg = x.groupBy("feature_name", "perturbation_pct", "direction").agg(
        F.count(F.lit(1)).alias("rows_changed"), F.avg("dp").alias("mean_abs_probability_delta"),
        F.max("dp").alias("max_abs_probability_delta"),
        F.avg("ratio").alias("mean_sensitivity_ratio"), F.max("ratio").alias("max_sensitivity_ratio"),
        F.avg(flip).alias("decision_flip_rate"), F.avg(band_change).alias("risk_band_change_rate"))
    agg = agg.join(_medians(x, ["feature_name", "perturbation_pct", "direction"], "dp"), ["feature_name", "perturbation_pct", "direction"])
    label = (F.when(F.col("mean_sensitivity_ratio") < SENSITIVITY_INSENSITIVE_MAX, "too_insensitive")
             .when(F.col("mean_sensitivity_ratio") > SENSITIVITY_OVERREACTIVE_MIN, "too_sensitive").otherwise("proportional"))
    r = lambda c: F.round(c, 8)
    return agg.select(
        F.lit(scorer.name).alias("model_name"), "feature_name", "perturbation_pct", "direction", "rows_changed",
        *[r(c).alias(c) for c in ["mean_abs_probability_delta", "median_abs_probability_delta", "max_abs_probability_delta",
                                   "mean_sensitivity_ratio", "max_sensitivity_ratio", "decision_flip_rate", "risk_band_change_rate"]],
        label.alias("sensitivity_label"))


def perturbation_summary(audit: DataFrame) -> DataFrame:
    """Per feature: scenarios, directions, mean and largest effects, and one label.

    ``mixed`` only if some scenario is too sensitive and some too insensitive;
    otherwise the extreme label that occurs, else ``proportional``.
    """
    has = lambda label: F.max((F.col("sensitivity_label") == label).cast("int")) == 1
    agg = audit.groupBy("model_name", "feature_name").agg(
        F.count(F.lit(1)).alias("scenarios"), F.countDistinct("direction").alias("directions_tested"),
        has("too_sensitive").alias("_over"), has("too_insensitive").alias("_under"),
        F.round(F.avg("mean_abs_probability_delta"), 8).alias("mean_abs_probability_delta"),
        F.round(F.avg("mean_sensitivity_ratio"), 8).alias("mean_sensitivity_ratio"),
        F.round(F.max("max_sensitivity_ratio"), 8).alias("max_sensitivity_ratio"),
        F.round(F.max("decision_flip_rate"), 8).alias("max_decision_flip_rate"),
        F.round(F.max(F.coalesce("risk_band_change_rate", F.lit(0.0))), 8).alias("max_risk_band_change_rate"))
    label = (F.when(F.col("_over") & F.col("_under"), "mixed").when(F.col("_over"), "too_sensitive")
             .when(F.col("_under"), "too_insensitive").otherwise("proportional"))
    return agg.select("model_name", "feature_name", "scenarios", "directions_tested", "mean_abs_probability_delta", "mean_sensitivity_ratio",
                      "max_sensitivity_ratio", "max_decision_flip_rate", "max_risk_band_change_rate", label.alias("overall_label"))


# ---------------------------------------------------------------- design audit
def design_audit(df: DataFrame, features: Sequence[str], target: str, split_col: str = "split", key: str = ROW_ID,
                 selection_splits: Sequence[str] = ("train",), policy_split: str = "validation") -> DataFrame:
    """Data-level leakage checks; each row: check, observed count, status (pass/review)."""
    feats = list(features)
    key_multi = df.groupBy(key).agg(F.countDistinct(split_col).alias("k")).agg(
        F.coalesce(F.sum((F.col("k") > 1).cast("long")), F.lit(0)).alias("v"))
    tr = df.filter(F.col(split_col) == "train").select(*feats).distinct()
    te = df.filter(F.col(split_col) == "test").select(*feats).distinct()
    cond = [tr[f].eqNullSafe(te[f]) for f in feats]
    overlap = tr.join(te, cond, "left_semi").agg(F.count(F.lit(1)).alias("v"))
    spark = df.sparkSession
    static = spark.createDataFrame([
        ("target_not_in_features", int(target in feats)),
        ("split_marker_not_in_features", int(split_col in feats)),
        ("selection_splits_within_train", int(any(s != "train" for s in selection_splits))),
        ("policy_split_not_test", int(policy_split == "test")),
    ], "check string, v long")
    dyn = key_multi.select(F.lit("row_keys_exclusive_to_one_split").alias("check"), "v").unionByName(
        overlap.select(F.lit("no_feature_tuple_shared_train_test").alias("check"), "v"))
    out = static.unionByName(dyn)
    return out.select("check", F.col("v").cast("long").alias("violations"),
                      F.when(F.col("v") == 0, "pass").otherwise("review").alias("status"))
