"""Scalar column expressions (all JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.config import ACTIONS, DEFAULT_ACTION, PROBABILITY_EPSILON


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_coerce(c: Column | str) -> Column:
    """Non-numeric / missing -> 0.0 (``try_cast`` trims blanks; 'NaN' -> 0; 'inf' stays inf)."""
    v = col_(c).cast("string").try_cast("double")
    return F.coalesce(F.nanvl(v, F.lit(None).cast("double")), F.lit(0.0))


def coerce_failed(c: Column | str) -> Column:
    """1 when :func:`clean_coerce` had to replace the value."""
    v = col_(c).cast("string").try_cast("double")
    return F.when(v.isNull() | F.isnan(v), 1).otherwise(0)


def zero_as_missing(c: Column | str) -> Column:
    return F.nullif(col_(c).cast("double"), F.lit(0.0))


def safe_divide(num: Column, den: Column) -> Column:
    """num / den, 0.0 when the denominator is 0."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def bin_cut(c: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins with the lowest edge included; outside / missing -> 'nan'."""
    v = col_(c)
    expr = None
    for upper, label in zip(edges[1:], labels):
        cond = v <= F.lit(float(upper))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return F.when(v.isNull() | (v < F.lit(float(edges[0]))), F.lit("nan")).otherwise(expr.otherwise(F.lit("nan")))


def threshold_category(c: Column | str, threshold: float, above: str, below: str) -> Column:
    """``c >= threshold -> above`` else ``below``; missing compares false -> below."""
    return F.when(col_(c) >= F.lit(threshold), F.lit(above)).otherwise(F.lit(below))


def cascade_band(c: Column | str, low: float, normal_upper: float, hidden_upper: float) -> Column:
    """<low 'low'; [low, normal_upper) 'normal'; [normal_upper, hidden_upper] 'hidden'; else 'high'."""
    v = col_(c)
    return (
        F.when(v < low, F.lit("low"))
        .when((v >= low) & (v < normal_upper), F.lit("normal"))
        .when((v >= normal_upper) & (v <= hidden_upper), F.lit("hidden"))
        .otherwise(F.lit("high"))
    )


def range_flag(c: Column | str, lo: float, hi: float, inside: str = "normal", outside: str = "abnormal") -> Column:
    return F.when(col_(c).between(lo, hi), F.lit(inside)).otherwise(F.lit(outside))


def clip_null_safe(c: Column | str, lo: Column | float, hi: Column | float) -> Column:
    """Clip to [lo, hi]; missing stays missing (``greatest/least`` alone skip NULLs)."""
    v = col_(c)
    lo_c = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi_c = hi if isinstance(hi, Column) else F.lit(float(hi))
    return F.when(v.isNull(), F.lit(None).cast("double")).otherwise(F.least(F.greatest(v, lo_c), hi_c))


def clip_probability(p: Column | str, eps: float = PROBABILITY_EPSILON) -> Column:
    return F.least(F.greatest(col_(p), F.lit(eps)), F.lit(1.0 - eps))


def decide(p: Column | str, threshold: Column | float) -> Column:
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (col_(p) >= t).cast("int")


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def risk_band(p: Column | str, bands: Sequence[tuple[str, str, float, float]], default: str | None = None) -> Column:
    """Label of the first band with ``min <= p < max`` (small fixed list -> a ``when`` chain)."""
    v = col_(p)
    expr = None
    for _, label, lo, hi in bands:
        cond = (v >= F.lit(float(lo))) & (v < F.lit(float(hi)))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default).cast("string"))


def recommended_action(band: Column | str) -> Column:
    key = F.lower(F.trim(F.coalesce(col_(band), F.lit(""))))
    expr = None
    for k, action in ACTIONS.items():
        expr = F.when(key == k, F.lit(action)) if expr is None else expr.when(key == k, F.lit(action))
    return expr.otherwise(F.lit(DEFAULT_ACTION))


def relative_delta_pct(cur: Column, ref: Column, eps: float = 1e-8) -> Column:
    """``abs((cur-ref)/ref)*100``; reference ~0 -> 0 if current ~0 else 100."""
    return (
        F.when(F.abs(ref) < eps, F.when(F.abs(cur) < eps, F.lit(0.0)).otherwise(F.lit(100.0)))
        .otherwise(F.abs((cur - ref) / ref) * 100.0)
    )


# Metric families of the selection utility.
BOUNDED_METRICS = (
    "roc_auc", "accuracy", "precision", "recall", "specificity", "f1", "false_positive_rate",
    "false_negative_rate", "brier", "calibration_slope_error", "calibration_intercept_abs",
    "tn_share", "fp_share", "fn_share", "tp_share", "positive_prediction_rate", "positive_prevalence",
)
COST_METRICS = ("log_loss", "expected_cost", "expected_cost_per_sample", "mape")


def component_utility(metric: Column, value: Column, direction: Column) -> Column:
    """Map a raw metric to [0, 1] by family and direction (missing -> 0.5).

    bounded: clip to [0,1] (maximize) or 1-clip; cost-like: 1/(1+max(v,0)) when
    minimized, else its complement; r2: clip((v+1)/2); mean_risk_score:
    clip(v/100) (maximize, else complement); other: 1/(1+|v|) when minimized.
    """
    clip01 = lambda e: F.least(F.greatest(e, F.lit(0.0)), F.lit(1.0))
    maximize = direction == "maximize"
    minimize = direction == "minimize"
    flip = lambda u, keep: F.when(keep, u).otherwise(F.lit(1.0) - u)
    cost = F.lit(1.0) / (F.lit(1.0) + F.greatest(value, F.lit(0.0)))
    other = F.lit(1.0) / (F.lit(1.0) + F.abs(value))
    u = (
        F.when(metric.isin(*BOUNDED_METRICS), flip(clip01(value), maximize))
        .when(metric.isin(*COST_METRICS), flip(cost, minimize))
        .when(metric == "r2", flip(clip01((value + 1.0) / 2.0), maximize))
        .when(metric == "mean_risk_score", flip(clip01(value / 100.0), maximize))
        .otherwise(flip(other, minimize))
    )
    return F.when(value.isNull() | F.isnan(value), F.lit(0.5)).otherwise(u)

