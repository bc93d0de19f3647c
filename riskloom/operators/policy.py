"""Decision-threshold policies.

The threshold sweep is one pass: each score is reduced to its *cell* — the
number of grid thresholds <= p — so ``p >= t_j  <=>  cell >= j``. Counts per
``(group, cell)`` (at most len(grid)+1 rows per group) are made dense, and
suffix sums over cells give the confusion counts at every threshold. No row
is ever repeated per threshold.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.config import POLICIES, THRESHOLD_GRID, Policy
from riskloom.operators.metrics import derive_threshold_metrics, threshold_metrics

METRIC_COLS = [
    "tn", "fp", "fn", "tp", "accuracy", "precision", "recall", "specificity", "f1",
    "false_positive_rate", "false_negative_rate", "positive_prediction_rate", "positive_prevalence",
    "tn_share", "fp_share", "fn_share", "tp_share", "mean_risk_score",
]


def grid_values(start: float = THRESHOLD_GRID[0], stop: float = THRESHOLD_GRID[1], step: float = THRESHOLD_GRID[2]) -> list[float]:
    """``arange(start, stop + step/2, step)`` clipped to [0, 1], rounded to 10 digits."""
    n = max(0, math.ceil((stop + step / 2 - start) / step))
    return [round(min(max(start + i * step, 0.0), 1.0), 10) for i in range(n)]


def threshold_grid(spark, start: float = THRESHOLD_GRID[0], stop: float = THRESHOLD_GRID[1], step: float = THRESHOLD_GRID[2]) -> DataFrame:
    n = max(0, math.ceil((stop + step / 2 - start) / step))
    return spark.range(0, n).select(
        (F.col("id") + 1).cast("int").alias("threshold_index"),
        F.round(F.least(F.greatest(F.lit(start) + F.col("id") * F.lit(step), F.lit(0.0)), F.lit(1.0)), 10).alias("threshold"),
    )


def _grid_array(grid: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(t)) for t in grid])


def sweep_counts(scores: DataFrame, keys: Sequence[str], grid: Sequence[float], y: str = "y", p: str = "p",
                 w: str | None = None) -> DataFrame:
    """Confusion counts at every grid threshold per group: ``(keys, threshold, tn, fp, fn, tp, _n, _sum_p)``."""
    keys = list(keys)
    g = len(grid)
    arr = _grid_array(grid)
    wt = F.col(w).cast("double") if w else F.lit(1.0)
    cell = F.size(F.filter(arr, lambda t: t <= F.col(p))).alias("cell")
    counts = scores.groupBy(*keys, cell).agg(
        F.sum(F.when(F.col(y) == 1, wt).otherwise(0.0)).alias("pos"),
        F.sum(F.when(F.col(y) == 0, wt).otherwise(0.0)).alias("neg"),
        F.sum(wt * F.col(p)).alias("sp"),
    )
    # dense (group, cell) grid: a generator over the distinct groups, not a join
    dense = counts.select(*keys).distinct().select(
        *keys, F.explode(F.sequence(F.lit(0), F.lit(g))).alias("cell"),
        F.lit(0.0).alias("pos"), F.lit(0.0).alias("neg"), F.lit(0.0).alias("sp"),
    )
    full = counts.unionByName(dense).groupBy(*keys, "cell").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("sp").alias("sp")
    )
    by_group = Window.partitionBy(*keys) if keys else Window.partitionBy()
    suffix = by_group.orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, 0)
    s = full.select(
        *keys, "cell",
        F.sum("pos").over(suffix).alias("tp"), F.sum("neg").over(suffix).alias("fp"),
        F.sum("pos").over(by_group).alias("P"), F.sum("neg").over(by_group).alias("N"),
        F.sum("sp").over(by_group).alias("_sum_p"),
    ).filter(F.col("cell") >= 1)
    return s.select(
        *keys,
        F.element_at(arr, F.col("cell")).alias("threshold"),
        "tp", "fp",
        (F.col("N") - F.col("fp")).alias("tn"),
        (F.col("P") - F.col("tp")).alias("fn"),
        (F.col("P") + F.col("N")).alias("_n"),
        "_sum_p",
    )


def threshold_sweep(scores: DataFrame, keys: Sequence[str], grid: Sequence[float] | None = None,
                    fn_cost: float = 1.0, fp_cost: float = 1.0, **kw) -> DataFrame:
    grid = grid_values() if grid is None else grid
    counts = sweep_counts(scores, keys, grid, **kw)
    return derive_threshold_metrics(counts, [*keys, "threshold"], fn_cost, fp_cost)


def policy_select(scores: DataFrame, keys: Sequence[str], policies: Sequence[Policy] = POLICIES,
                  grid: Sequence[float] | None = None, **kw) -> DataFrame:
    """One row per (group, policy) with the chosen threshold and its metrics."""
    keys = list(keys)
    grid = grid_values() if grid is None else grid
    out = []
    fixed = [p for p in policies if p.strategy == "fixed_threshold"]
    costed = [p for p in policies if p.strategy != "fixed_threshold"]
    cols = [*keys, "policy_name", "policy_label", "strategy", "threshold", "constraint_satisfied", *METRIC_COLS,
            "expected_cost", "expected_cost_per_sample"]
    for pol in fixed:
        m = threshold_metrics(scores, keys, pol.threshold, fn_cost=pol.fn_cost, fp_cost=pol.fp_cost, **kw)
        out.append(m.select(
            *keys, F.lit(pol.name).alias("policy_name"), F.lit(pol.label).alias("policy_label"),
            F.lit(pol.strategy).alias("strategy"), F.col("threshold"), F.lit(True).alias("constraint_satisfied"),
            *METRIC_COLS, "expected_cost", "expected_cost_per_sample",
        ))
    if costed:
        counts = sweep_counts(scores, keys, grid, **kw)
        pol_arr = F.array(*[
            F.struct(F.lit(p.name).alias("name"), F.lit(p.label).alias("label"), F.lit(p.strategy).alias("strategy"),
                     F.lit(float(p.fn_cost)).alias("fnc"), F.lit(float(p.fp_cost)).alias("fpc"),
                     F.lit(float(p.min_recall)).alias("min_recall"), F.lit(float(p.min_precision)).alias("min_precision"),
                     F.lit(float(p.min_specificity)).alias("min_specificity"))
            for p in costed
        ])
        per_pol = counts.withColumn("pol", F.explode(pol_arr))
        m = derive_threshold_metrics(per_pol, [*keys, "threshold", "pol"], F.col("pol.fnc"), F.col("pol.fpc"))
        elig = ((F.col("recall") >= F.col("pol.min_recall")) & (F.col("precision") >= F.col("pol.min_precision"))
                & (F.col("specificity") >= F.col("pol.min_specificity")))
        m = m.withColumn("constraint_satisfied", elig)
        w = Window.partitionBy(*keys, "pol.name").orderBy(
            F.col("constraint_satisfied").desc(), F.col("expected_cost"), F.col("false_negative_rate"),
            F.col("recall").desc(), F.col("threshold"),
        )
        best = m.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") == 1)
        out.append(best.select(
            *keys, F.col("pol.name").alias("policy_name"), F.col("pol.label").alias("policy_label"),
            F.col("pol.strategy").alias("strategy"), "threshold", "constraint_satisfied", *METRIC_COLS,
            "expected_cost", "expected_cost_per_sample",
        ))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res.select(*cols)


def deployment_row(selected: DataFrame, keys: Sequence[str], name: str, order: Sequence[str]) -> DataFrame:
    """The configured policy row per group, else the first policy in configured order."""
    order_expr = F.when(F.col("policy_name") == name, 0).otherwise(
        F.array_position(F.array(*[F.lit(n) for n in order]), F.col("policy_name")).cast("int")
    )
    w = Window.partitionBy(*keys).orderBy(order_expr)
    return selected.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") == 1).drop("_rk")
