"""Probability and threshold metrics over a long ``scores`` table.

Every metric is a grouped aggregation over weighted cells
``(<keys>, y, p, w)``: a row-level scores table has ``w = 1``; a bootstrap
resample carries Poisson weights. Rows are first collapsed to cells
``(keys, y, round(clip(p), 9))`` — the only thing AUC / log-loss / Brier /
calibration need — so later work scales with distinct scores, not rows.

Scale notes
* AUC needs, per group, the weighted count of negatives below each score.
  A single ``Window.partitionBy(keys)`` would put a whole group in one task,
  so scores are bucketed on a fixed 2**20 grid of [0, 1]: pairs within a bucket come
  from a window over at most ~1000 distinct rounded scores, pairs across buckets
  from a bucket-level prefix sum (<= 2**20 rows per group).
* Everything else is read off bins of the logit, counted in one pass in which no row moves.
* Calibration is a 2-parameter Newton fit on bins of the logit with their power
  sums: one grouped aggregate, then every group solves its bounded bins.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.config import PROBABILITY_EPSILON
from riskloom.functions.expressions import clip_probability, safe_divide
from riskloom.operators.ranking import null_safe_join

ROUND_P = 9
ROUND_OUT = 9
AUC_GRID = 2**20
#: Inverse penalty on the calibration parameters (the weight of the log-likelihood against half their squared length).
CALIBRATION_C = 1e6
#: Bins for each unit of the logit: about 16,000 for clipped probabilities.
LOGIT_BINS = 592


def _w(df: DataFrame, w: str | None) -> Column:
    return F.col(w).cast("double") if w else F.lit(1.0)


def to_cells(scores: DataFrame, keys: Sequence[str], y: str = "y", p: str = "p", w: str | None = None) -> DataFrame:
    """Collapse to ``(keys, y, p = round(clip(p), 9), w = sum of weights)``."""
    pr = F.round(clip_probability(F.col(p)), ROUND_P)
    return scores.groupBy(*keys, F.col(y).cast("int").alias("y"), pr.alias("p")).agg(F.sum(_w(scores, w)).alias("w"))


# --------------------------------------------------------------- threshold
def confusion_exprs(y: Column, p: Column, t: Column, w: Column) -> list[Column]:
    pos_pred = p >= t
    return [
        F.sum(F.when(pos_pred & (y == 0), w).otherwise(0.0)).alias("fp"),
        F.sum(F.when(pos_pred & (y == 1), w).otherwise(0.0)).alias("tp"),
        F.sum(F.when(~pos_pred & (y == 0), w).otherwise(0.0)).alias("tn"),
        F.sum(F.when(~pos_pred & (y == 1), w).otherwise(0.0)).alias("fn"),
        F.sum(w * p).alias("_sum_p"),
        F.sum(w).alias("_n"),
    ]


def derive_threshold_metrics(agg: DataFrame, keep: Sequence[str], fn_cost: Column | float = 1.0,
                             fp_cost: Column | float = 1.0, prefix: str = "") -> DataFrame:
    """Ratios with safe division from ``tn, fp, fn, tp, _n, _sum_p`` columns."""
    tp, fp, tn, fn, n = (F.col(c) for c in ("tp", "fp", "tn", "fn", "_n"))
    fnc = fn_cost if isinstance(fn_cost, Column) else F.lit(float(fn_cost))
    fpc = fp_cost if isinstance(fp_cost, Column) else F.lit(float(fp_cost))
    precision = safe_divide(tp, tp + fp)
    recall = safe_divide(tp, tp + fn)
    r = lambda e: F.round(e, ROUND_OUT)
    cost = fn * fnc + fp * fpc
    cols = {
        "tn": tn.cast("long"), "fp": fp.cast("long"), "fn": fn.cast("long"), "tp": tp.cast("long"),
        "accuracy": r(safe_divide(tp + tn, n)),
        "precision": r(precision),
        "recall": r(recall),
        "specificity": r(safe_divide(tn, tn + fp)),
        "f1": r(safe_divide(2 * precision * recall, precision + recall)),
        "false_positive_rate": r(safe_divide(fp, fp + tn)),
        "false_negative_rate": r(safe_divide(fn, fn + tp)),
        "positive_prediction_rate": r(safe_divide(tp + fp, n)),
        "positive_prevalence": r(safe_divide(tp + fn, n)),
        "tn_share": r(safe_divide(tn, n)),
        "fp_share": r(safe_divide(fp, n)),
        "fn_share": r(safe_divide(fn, n)),
        "tp_share": r(safe_divide(tp, n)),
        "mean_risk_score": r(safe_divide(F.col("_sum_p"), n)),
        "expected_cost": r(cost),
        "expected_cost_per_sample": r(safe_divide(cost, n)),
    }
    return agg.select(*keep, *[v.alias(prefix + k) for k, v in cols.items()])


def threshold_metrics(scores: DataFrame, keys: Sequence[str], threshold: float | str, y: str = "y",
                      p: str = "p", w: str | None = None, fn_cost: float = 1.0, fp_cost: float = 1.0) -> DataFrame:
    """Counts and rates at ``p >= threshold`` per group (threshold literal or column)."""
    t = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
    gkeys = list(keys) + ([threshold] if isinstance(threshold, str) else [])
    agg = scores.groupBy(*gkeys).agg(*confusion_exprs(F.col(y), F.col(p), t, _w(scores, w)))
    out = derive_threshold_metrics(agg, gkeys, fn_cost, fp_cost)
    if not isinstance(threshold, str):
        out = out.withColumn("threshold", F.lit(float(threshold)))
    return out


# ---------------------------------------------------------------- AUC etc.
def roc_auc(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tie-aware ROC AUC per group from cells; NULL (NaN) when a group has one class."""
    keys = list(keys)
    pc = cells.groupBy(*keys, "p").agg(
        F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0.0)).alias("pos"),
        F.sum(F.when(F.col("y") == 0, F.col("w")).otherwise(0.0)).alias("neg"),
    ).withColumn("_b", F.floor(F.col("p") * AUC_GRID).cast("int"))
    before_p = Window.partitionBy(*keys, "_b").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    inner = pc.withColumn("_cum", F.coalesce(F.sum("neg").over(before_p), F.lit(0.0)))
    buckets = inner.groupBy(*keys, "_b").agg(
        F.sum(F.col("pos") * (F.col("_cum") + F.lit(0.5) * F.col("neg"))).alias("_in"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    before_b = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    agg = buckets.withColumn("_off", F.coalesce(F.sum("neg").over(before_b), F.lit(0.0))).groupBy(*keys).agg(
        F.sum(F.col("_in") + F.col("pos") * F.col("_off")).alias("_num"),
        F.sum("pos").alias("_P"),
        F.sum("neg").alias("_N"),
    )
    auc = F.when((F.col("_P") > 0) & (F.col("_N") > 0), F.col("_num") / (F.col("_P") * F.col("_N")))
    return agg.select(*keys, F.round(auc, ROUND_OUT).alias("roc_auc"))


def brier_logloss(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _brier_of(cells.groupBy(*keys).agg(*_error_sums(F.col("y"), F.col("p"), F.col("w")), F.sum("w").alias("_n")), keys)


def _error_sums(y: Column, p: Column, w: Column) -> list[Column]:
    return [F.sum(w * (p - y) * (p - y)).alias("_se"), F.sum(w * -(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("_ll")]


def _brier_of(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    return sums.select(
        *keys,
        F.round(safe_divide(F.col("_se"), F.col("_n")), ROUND_OUT).alias("brier"),
        F.round(safe_divide(F.col("_ll"), F.col("_n")), ROUND_OUT).alias("log_loss"),
    )


def _newton(centre: np.ndarray, n: np.ndarray, moments: list[np.ndarray], pos: float, pos_x: float, tol: float, max_rounds: int) -> tuple[float, float, bool]:
    """Intercept, slope and whether the steps became small, from the bins of one group.

    `moments` are the sums of n * (x - centre) ** j for j = 2, 3, 4 about each bin's mean.
    """
    m2, m3, m4 = moments

    def sums(a: float, b: float) -> tuple[float, float, float, float, float, float]:
        z = a + b * centre
        e = np.exp(-np.abs(z))
        s = np.where(z >= 0, 1 / (1 + e), e / (1 + e))
        soft = np.maximum(z, 0.0) + np.log1p(e)
        # derivatives of the logistic function carry each bin's spread
        d1 = s * (1 - s)
        d2, d3, d4 = d1 * (1 - 2 * s), d1 * (1 - 6 * s + 6 * s * s), d1 * (1 - 2 * s) * (1 - 12 * s + 12 * s * s)
        at = n * s + d2 * b**2 * m2 / 2 + d3 * b**3 * m3 / 6 + d4 * b**4 * m4 / 24
        off = d1 * b * m2 + d2 * b**2 * m3 / 2 + d3 * b**3 * m4 / 6
        h = n * d1
        value = a * pos + b * pos_x - (n * soft + d1 * b**2 * m2 / 2 + d2 * b**3 * m3 / 6 + d3 * b**4 * m4 / 24).sum()
        return value, pos - at.sum(), pos_x - (at * centre + off).sum(), h.sum(), (h * centre).sum(), (h * centre * centre + d1 * m2).sum()

    a, b = 0.0, 1.0
    value, g0, g1, h00, h01, h11 = sums(a, b)
    value -= b * b / (2 * CALIBRATION_C)
    for _ in range(max_rounds):
        g1, h11, damp = g1 - b / CALIBRATION_C, h11 + 1 / CALIBRATION_C, 0.0
        while (det := (h00 + damp) * (h11 + damp) - h01 * h01) <= 1e-14 * (h00 + damp) * (h11 + damp):
            damp = max(1e-9 * (h00 + h11), 10 * damp, 1e-12)
        step = ((h11 + damp) * g0 - h01 * g1) / det, ((h00 + damp) * g1 - h01 * g0) / det
        if max(abs(d) / max(1.0, abs(v)) for v, d in zip((a, b), step, strict=True)) < tol:
            return a, b, True
        share = 1.0
        while True:
            new_a, new_b = a + share * step[0], b + share * step[1]
            new = sums(new_a, new_b)
            new_value = new[0] - new_b * new_b / (2 * CALIBRATION_C)
            if new_value >= value - 1e-11 * abs(value) or share < 1e-8:
                break
            share /= 2
        a, b, value = new_a, new_b, new_value
        _, g0, g1, h00, h01, h11 = new
    return a, b, False


def calibration_of_bins(place: np.ndarray, powers: np.ndarray, pos: float, pos_x: float, bins: int, tol: float = 1e-9, max_rounds: int = 200) -> tuple[float, float, bool]:
    """Intercept, slope and whether converged, from bins of the logit: `powers` are sums of weight * (x - middle of the bin) ** (0 to 4)."""
    some = powers[0] > 0
    m0, m1, m2, m3, m4 = powers[:, some]
    if not 0 < pos < m0.sum():
        return 0.0, 1.0, True
    mean = m1 / m0
    about = [m2 - m0 * mean**2, m3 - 3 * mean * m2 + 2 * m0 * mean**3, m4 - 4 * mean * m3 + 6 * mean**2 * m2 - 3 * m0 * mean**4]
    return _newton((place[some] + 0.5) / bins + mean, m0, about, pos, pos_x, tol, max_rounds)


def calibration_fit(cells: DataFrame, keys: Sequence[str], tol: float = 1e-9, max_rounds: int = 200) -> DataFrame:
    """Logistic recalibration ``y ~ a + b*logit(p)`` per group by damped Newton steps.

    Maximises ``C * log-likelihood - b*b / 2`` (the slope is penalised, the
    intercept is not), so separable scores have a finite answer too. Groups
    with one class give slope 1, intercept 0. ``converged`` tells whether the
    step became smaller than ``tol`` (relative).

    Logits are collapsed to bins of 1 / LOGIT_BINS with the sums of their powers, in one
    grouped aggregate; a group's bins (their number is bounded, as p is clipped) are all that its
    steps read, so all groups are solved in one stage. The power sums stand for the logits within a
    bin to the fourth order: an error below 1e-11 of a bin's weight for slopes up to 10, and none
    in a bin with one logit.
    """
    bin_, sums = _logit_bins(F.col("y"), F.col("p"), F.col("w"))
    return _calibration_of(cells.withColumn("_bin", bin_).groupBy(*keys, "_bin").agg(*sums), keys, tol, max_rounds)


def _logit_bins(y: Column, p: Column, w: Column) -> tuple[Column, list[Column]]:
    """The bin of a logit, and the sums of a bin that a calibration reads (grouped by it as `_bin`)."""
    x, pos = F.log(p / (1 - p)), F.when(y == 1, w).otherwise(0.0)
    gap = x - (F.col("_bin") + 0.5) / LOGIT_BINS
    powers = [F.sum(w * gap**j if j else w).alias(f"_m{j}") for j in range(5)]
    return F.floor(x * LOGIT_BINS), [*powers, F.sum(pos).alias("_pos"), F.sum(pos * x).alias("_pos_x")]


def _calibration_of(binned: DataFrame, keys: Sequence[str], tol: float = 1e-9, max_rounds: int = 200) -> DataFrame:
    keys = list(keys)
    fields = binned.select(*keys).schema.fields

    def solve(table: pa.Table) -> pa.Table:
        powers = np.stack([table.column(f"_m{j}").to_numpy() for j in range(5)])
        pos, pos_x = (float(table.column(c).to_numpy().sum()) for c in ("_pos", "_pos_x"))
        a, b, done = calibration_of_bins(table.column("_bin").to_numpy(), powers, pos, pos_x, LOGIT_BINS, tol, max_rounds)
        head = table.slice(0, 1).select(keys)
        for name, value, kind in (("a", a, pa.float64()), ("b", b, pa.float64()), ("converged", done, pa.bool_())):
            head = head.append_column(name, pa.array([value], kind))
        return head

    schema = T.StructType([*fields, T.StructField("a", T.DoubleType()), T.StructField("b", T.DoubleType()), T.StructField("converged", T.BooleanType())])
    return binned.groupBy(*keys).applyInArrow(solve, schema).select(
        *keys,
        F.round(F.col("b"), 7).alias("calibration_slope"),
        F.round(F.col("a"), 7).alias("calibration_intercept"),
        F.round(F.abs(F.col("b") - 1), 7).alias("calibration_slope_error"),
        F.round(F.abs(F.col("a")), 7).alias("calibration_intercept_abs"),
        "converged",
    )


COUNT_METRICS = ["roc_auc", "brier", "log_loss", "calibration_slope", "calibration_intercept", "calibration_slope_error", "calibration_intercept_abs"]


def metrics_of_counts(p: np.ndarray, neg: np.ndarray, pos: np.ndarray) -> dict[str, float | None]:
    """What :func:`probability_metrics` gives for one group, from its numbers of negatives and positives at ascending probabilities `p`."""
    some = neg + pos > 0
    p, neg, pos = np.round(np.clip(p[some], PROBABILITY_EPSILON, 1 - PROBABILITY_EPSILON), ROUND_P), neg[some], pos[some]
    n, n_pos, n_neg = float((neg + pos).sum()), float(pos.sum()), float(neg.sum())
    # clipping may make neighbours equal: their pairs are ties
    p, at = np.unique(p, return_inverse=True)
    neg, pos = np.bincount(at, neg, len(p)), np.bincount(at, pos, len(p))
    x = np.log(p / (1 - p))
    bin_ = np.floor(x * LOGIT_BINS)
    place, at = np.unique(bin_, return_inverse=True)
    gap = x - (bin_ + 0.5) / LOGIT_BINS
    powers = np.stack([np.bincount(at, (neg + pos) * gap**j, len(place)) for j in range(5)])
    a, b, _ = calibration_of_bins(place, powers, n_pos, float((pos * x).sum()), LOGIT_BINS)
    r = lambda v, digits=ROUND_OUT: round(float(v), digits)
    return {
        "roc_auc": r((pos * (np.cumsum(neg) - 0.5 * neg)).sum() / (n_pos * n_neg)) if n_pos and n_neg else None,
        "brier": r((neg * p * p + pos * (1 - p) ** 2).sum() / n), "log_loss": r(-(pos * np.log(p) + neg * np.log(1 - p)).sum() / n),
        "calibration_slope": r(b, 7), "calibration_intercept": r(a, 7), "calibration_slope_error": r(abs(b - 1), 7), "calibration_intercept_abs": r(abs(a), 7),
    }


def probability_metrics(cells: DataFrame, keys: Sequence[str], calibration: bool = True) -> DataFrame:
    out = null_safe_join(roc_auc(cells, keys), brier_logloss(cells, keys), list(keys))
    if calibration:
        out = null_safe_join(out, calibration_fit(cells, keys).drop("converged"), list(keys))
    return out


def metric_payload(scores: DataFrame, keys: Sequence[str], threshold: float, fn_cost: float = 1.0,
                   fp_cost: float = 1.0, y: str = "y", p: str = "p", w: str | None = None,
                   calibration: bool = True) -> DataFrame:
    """Threshold metrics + expected cost + probability metrics, one row per group.

    The scores are read twice (give a table, or a projection of one) and not kept: once for bins of the
    logit, whose sums give the threshold, Brier, log-loss and calibration metrics, and
    once for the AUC. The bins are persisted (at most about 16,000 a group); the result has one row
    per group (config-bounded: models x splits / folds / iterations), so it is collected.
    """
    from pyspark import StorageLevel

    keys = list(keys)
    rounded = F.round(clip_probability(F.col(p)), ROUND_P)
    src = scores.select(*keys, F.col(y).alias("_y"), F.col(p).alias("_p"), F.col(y).cast("int").alias("y"), rounded.alias("p"), _w(scores, w).alias("w"))
    bin_, powers = _logit_bins(F.col("y"), F.col("p"), F.col("w"))
    counts = confusion_exprs(F.col("_y"), F.col("_p"), F.lit(float(threshold)), F.col("w"))
    sums = [*counts, *_error_sums(F.col("y"), F.col("p"), F.col("w")), *(powers if calibration else [])]
    binned = src.withColumn("_bin", bin_ if calibration else F.lit(0)).groupBy(*keys, "_bin").agg(*sums).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        total = binned.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("fp", "tp", "tn", "fn", "_sum_p", "_n", "_se", "_ll")])
        thr = derive_threshold_metrics(total, keys, fn_cost, fp_cost).withColumn("threshold", F.lit(float(threshold)))
        out = null_safe_join(thr, null_safe_join(roc_auc(src, keys), _brier_of(total, keys), keys), keys)
        if calibration:
            out = null_safe_join(out, _calibration_of(binned, keys).drop("converged"), keys)
        schema = out.schema
        rows = out.collect()
    finally:
        binned.unpersist()
    return scores.sparkSession.createDataFrame(rows, schema)


def fit_quality(scores: DataFrame, keys: Sequence[str], y: str = "y", p: str = "p", w: str | None = None) -> DataFrame:
    """r2 of the probabilities (0 with one class) and their mean absolute error in percent of the mean label, per group."""
    yc, pc, wt = F.col(y).cast("double"), F.col(p), _w(scores, w)
    sums = scores.groupBy(*keys).agg(F.sum(wt).alias("_n"), F.sum(wt * yc).alias("_y"), F.sum(wt * (yc - pc) * (yc - pc)).alias("_se"), F.sum(wt * F.abs(yc - pc)).alias("_ae"))
    mean = F.col("_y") / F.col("_n")
    # the labels are 0 and 1: their squares sum to what they sum to
    spread = F.col("_y") - F.col("_n") * mean * mean
    one_class = (F.col("_y") == 0) | (F.col("_y") == F.col("_n"))
    return sums.select(
        *keys,
        F.round(F.when(one_class, F.lit(0.0)).otherwise(1 - F.col("_se") / spread), ROUND_OUT).alias("r2"),
        F.round(F.col("_ae") / F.col("_n") / F.greatest(mean, F.lit(1e-8)) * 100.0, 6).alias("mape"),
    )


def evaluate(scores: DataFrame, splits: Sequence[str], threshold: float = 0.5, fn_cost: float = 1.0, fp_cost: float = 1.0) -> DataFrame:
    """Every metric of each (model, split); a split without rows has a row of zeros for every model."""
    keys = ["model_name", "split"]
    own = scores.filter(F.col("split").isin(*splits))
    pay = null_safe_join(metric_payload(own, keys, threshold, fn_cost, fp_cost), fit_quality(own, keys), keys)
    pay = pay.withColumn("n_samples", F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"))
    # models x configured splits
    dense = scores.select("model_name").distinct().withColumn("split", F.explode(F.array(*[F.lit(s) for s in splits])))
    metrics = [c for c in pay.columns if c not in keys]
    out = null_safe_join(dense, pay, keys, "left")
    zero = lambda c: F.when(F.col("n_samples").isNull(), F.lit(threshold if c == "threshold" else 0)).otherwise(F.col(c)).cast(pay.schema[c].dataType).alias(c)
    return out.select(*keys, *[zero(c) for c in metrics])
