"""Leakage-free fit/transform preprocessing.

``fit_*`` functions look only at rows of the fit splits and return a small
parameter table (one row per column) — the only driver round trip is the
collection of those parameters. ``transform_*`` functions are pure
projections (map-only, inside whole-stage codegen).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.config import (
    CAP_IQR_MULT,
    CAP_LOWER_Q,
    CAP_UPPER_Q,
    CATEGORY_ORDERS,
    SPLIT_COL,
)
from riskloom.functions.expressions import clip_null_safe, zero_as_missing
from riskloom.operators.quantiles import exact_quantiles


def fit_rows(df: DataFrame, fit_splits: Sequence[str] | None, split_col: str = SPLIT_COL) -> DataFrame:
    """Rows the fitted steps may learn from (``None`` = all rows, as in refit)."""
    if fit_splits is None:
        return df
    return df.filter(F.col(split_col).isin(list(fit_splits)))


def _params_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# --------------------------------------------------------------------- caps
def fit_caps(
    df: DataFrame,
    columns: Sequence[str],
    fit_splits: Sequence[str] | None = ("train",),
    lower_q: float = CAP_LOWER_Q,
    upper_q: float = CAP_UPPER_Q,
    multiplier: float = CAP_IQR_MULT,
) -> dict[str, tuple[float, float]]:
    """Per column ``(q_lo - m*(q_hi-q_lo), q_hi + m*(q_hi-q_lo))`` on fit rows."""
    qs = exact_quantiles(fit_rows(df, fit_splits), columns, [lower_q, upper_q])
    caps = {}
    for c in columns:
        a, b = qs[c]
        if a is None:
            caps[c] = (None, None)
            continue
        iqr = b - a
        caps[c] = (a - multiplier * iqr, b + multiplier * iqr)
    return caps


def caps_table(spark: SparkSession, caps: dict[str, tuple[float, float]]) -> DataFrame:
    return _params_frame(spark, [(c, lo, hi) for c, (lo, hi) in caps.items()], "feature string, lower double, upper double")


def transform_caps(df: DataFrame, caps: dict[str, tuple[float, float]]) -> DataFrame:
    """Clip each column to its fitted bounds; missing stays missing."""
    return df.withColumns(
        {c: clip_null_safe(c, lo, hi) for c, (lo, hi) in caps.items() if lo is not None}
    )


# ------------------------------------------------------------ robust scaler
def fit_robust_scale(df: DataFrame, columns: Sequence[str], fit_splits: Sequence[str] | None = ("train",)) -> dict[str, tuple[float, float]]:
    """Median and IQR (25-75) per column ignoring missing; IQR 0 -> 1."""
    qs = exact_quantiles(fit_rows(df, fit_splits), columns, [0.25, 0.5, 0.75])
    out = {}
    for c in columns:
        q1, med, q3 = qs[c]
        if med is None:
            out[c] = (0.0, 1.0)
            continue
        iqr = q3 - q1
        out[c] = (med, iqr if iqr != 0 else 1.0)
    return out


# ----------------------------------------------------------- standard scaler
def fit_standard(df: DataFrame, columns: Sequence[str], fit_splits: Sequence[str] | None = ("train",)) -> dict[str, tuple[float, float]]:
    """Mean and population std per column in one aggregate; std 0 -> 1."""
    fit = fit_rows(df, fit_splits)
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    row = fit.agg(*aggs).head()
    out = {}
    for c in columns:
        m, s = row[f"m_{c}"], row[f"s_{c}"]
        out[c] = (0.0 if m is None else float(m), 1.0 if (s is None or s == 0) else float(s))
    return out


def standard_table(spark: SparkSession, params: dict[str, tuple[float, float]]) -> DataFrame:
    return _params_frame(spark, [(c, m, s) for c, (m, s) in params.items()], "feature string, mean double, scale double")


def transform_standard(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in params.items()})


# ------------------------------------------------------------------ one-hot
def fit_onehot(
    df: DataFrame,
    columns: Sequence[str],
    fit_splits: Sequence[str] | None = ("train",),
    category_orders: dict[str, list[str]] | None = None,
) -> dict[str, list[str]]:
    """Category list per column: configured order, else sorted distinct of fit rows."""
    orders = CATEGORY_ORDERS if category_orders is None else category_orders
    out: dict[str, list[str]] = {}
    missing = [c for c in columns if c not in orders]
    if missing:
        fit = fit_rows(df, fit_splits)
        long = fit.select(F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias("v")) for c in missing])).alias("s"))
        # the distinct pairs are found and sorted by shuffles; what returns is the fitted parameter itself
        for r in long.select("s.f", "s.v").distinct().orderBy("f", "v").toLocalIterator():
            out.setdefault(r["f"], []).append(r["v"])
    for c in columns:
        if c in orders:
            out[c] = [str(v) for v in orders[c]]
    return out


def onehot_columns(categories: dict[str, list[str]]) -> list[str]:
    """Output names with the first category dropped."""
    return [f"{c}_{v}" for c, vals in categories.items() for v in vals[1:]]


def transform_onehot(df: DataFrame, categories: dict[str, list[str]]) -> DataFrame:
    """Replace each column by ``col_value`` 0/1 doubles (first dropped; unknown -> zeros)."""
    if not categories:
        return df
    keep = [c for c in df.columns if c not in categories]
    new = []
    for c, vals in categories.items():
        v = F.coalesce(F.col(c).cast("string"), F.lit("nan"))
        new += [(v == F.lit(val)).cast("double").alias(f"{c}_{val}") for val in vals[1:]]
    return df.select(*[F.col(c) for c in keep], *new)


# ------------------------------------------------------------ label encoder
def fit_label_encoder(df: DataFrame, target: str) -> DataFrame:
    """Sorted distinct target values -> dense codes 0..k-1 (bounded by the class count)."""
    from pyspark.sql import Window

    labels = df.select(F.col(target).alias("label")).distinct()
    return labels.select("label", (F.dense_rank().over(Window.orderBy("label")) - 1).cast("int").alias("code"))


# -------------------------------------------------------------- class weights
def class_weights(df: DataFrame, target: str, mode: str = "balanced") -> DataFrame:
    """``balanced``: n/(k*n_c); ``ratio`` (boosted family): neg/pos on positives, 1 on negatives."""
    from pyspark.sql import Window

    counts = df.groupBy(F.col(target).alias("label")).agg(F.count(F.lit(1)).alias("n_class"))
    whole = Window.partitionBy()  # one row per class: bounded
    n = F.sum("n_class").over(whole)
    k = F.count(F.lit(1)).over(whole)
    if mode == "balanced":
        w = n.cast("double") / (k * F.col("n_class"))
    else:
        neg = F.sum(F.when(F.col("label") == 0, F.col("n_class")).otherwise(0)).over(whole)
        pos = F.sum(F.when(F.col("label") == 1, F.col("n_class")).otherwise(0)).over(whole)
        w = F.when(F.col("label") == 1, F.when(pos > 0, neg.cast("double") / pos).otherwise(F.lit(1.0))).otherwise(F.lit(1.0))
    return counts.select("label", "n_class", w.alias("weight"))


# ------------------------------------------------------------- imputation
def fit_impute_stat(df: DataFrame, columns: Sequence[str], fit_splits: Sequence[str] | None = ("train",),
                    zero_missing: bool = True) -> dict[str, float | None]:
    """Median per column on fit rows (zeros treated as missing when configured)."""
    fit = fit_rows(df, fit_splits)
    if zero_missing:
        fit = fit.select(*[zero_as_missing(c).alias(c) for c in columns])
    qs = exact_quantiles(fit, columns, [0.5])
    return {c: qs[c][0] for c in columns}


def transform_impute_stat(df: DataFrame, medians: dict[str, float | None], zero_missing: bool = True) -> DataFrame:
    out = {}
    for c, m in medians.items():
        v = zero_as_missing(c) if zero_missing else F.col(c)
        out[c] = F.coalesce(v, F.lit(m).cast("double"))
    return df.withColumns(out)
