"""Deterministic train/validation/test splits and cross-validation folds.

Order inside each stratum is ``md5('<seed>:<purpose>:<row_id>')`` with
``row_id`` as tie-breaker, so splits are exact in proportion, independent
of partitioning and identical in any engine with md5 + row_number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.config import MIN_ROWS_FOR_STRATIFY, ROW_ID, SPLIT_COL, SPLIT_RATIOS
from riskloom.functions.hashing import keyed_md5, uniform01_fine
from riskloom.operators.ranking import label_by_hash, rank_by_hash


def normalise_ratios(ratios: Sequence[tuple[str, float]]) -> list[tuple[str, float]]:
    total = float(sum(r for _, r in ratios))
    if total <= 0:
        raise ValueError("split ratios must sum to a positive value")
    return [(n, float(r) / total) for n, r in ratios]


def _cumulative(ratios: Sequence[tuple[str, float]]) -> list[tuple[str, float]]:
    out, acc = [], 0.0
    for name, r in normalise_ratios(ratios):
        acc += r
        out.append((name, round(acc, 12)))
    return out


def _assign_by_rank(rank: Column, n: Column, ratios: Sequence[tuple[str, float]]) -> Column:
    cum = _cumulative(ratios)
    expr = None
    for name, c in cum[:-1]:
        cond = rank <= F.floor(n * F.lit(c))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    last = F.lit(cum[-1][0])
    return last if expr is None else expr.otherwise(last)


def split_stratified(
    df: DataFrame,
    strat_col: str,
    ratios: Sequence[tuple[str, float]] = SPLIT_RATIOS,
    seed: int = 42,
    key: str = ROW_ID,
    out_col: str = SPLIT_COL,
) -> DataFrame:
    """Class-proportional split: per stratum the first ``floor(n*cum_ratio)`` rows in hash order."""
    x = df.withColumn("_rl_h", keyed_md5(seed, "split", key))
    x = label_by_hash(x, [strat_col], "_rl_h", key, lambda rank, n: _assign_by_rank(rank, n, ratios), label_name=out_col)
    return x.drop("_rl_h")


def split_random(
    df: DataFrame,
    ratios: Sequence[tuple[str, float]] = SPLIT_RATIOS,
    seed: int = 42,
    key: str = ROW_ID,
    out_col: str = SPLIT_COL,
) -> DataFrame:
    """i.i.d. assignment by a keyed uniform against cumulative ratios (map-only, no shuffle)."""
    u = uniform01_fine(seed, "random_split", key)
    cum = _cumulative(ratios)
    expr = None
    for name, c in cum[:-1]:
        expr = F.when(u < F.lit(c), F.lit(name)) if expr is None else expr.when(u < F.lit(c), F.lit(name))
    last = F.lit(cum[-1][0])
    return df.withColumn(out_col, last if expr is None else expr.otherwise(last))


def split_with_fallback(
    df: DataFrame,
    kind: str = "stratified_random",
    strat_col: str | None = "Outcome",
    ratios: Sequence[tuple[str, float]] = SPLIT_RATIOS,
    seed: int = 42,
    min_rows: int = MIN_ROWS_FOR_STRATIFY,
) -> tuple[DataFrame, dict]:
    """Dispatch on the configured strategy; stratified falls back to random with a reason."""
    info = {"strategy_requested": kind, "strategy_resolved": kind, "fallback": False, "reason": None}
    if kind == "random":
        return split_random(df, ratios, seed), info
    if kind != "stratified_random":
        raise ValueError(f"unsupported split strategy: {kind}")
    reason = None
    if not strat_col or strat_col not in df.columns:
        reason = f"stratify column {strat_col!r} not found"
    else:
        # only needs to know whether there are at least min_rows rows
        if len(df.select(strat_col).limit(min_rows).collect()) < min_rows:
            reason = f"fewer than {min_rows} rows"
    if reason:
        info.update(strategy_resolved="random", fallback=True, reason=reason)
        return split_random(df, ratios, seed), info
    return split_stratified(df, strat_col, ratios, seed), info


def split_report(df: DataFrame, ratios: Sequence[tuple[str, float]] = SPLIT_RATIOS,
                 requested: str = "stratified_random", resolved: str = "stratified_random",
                 fallback_reason: str | None = None, split_col: str = SPLIT_COL) -> DataFrame:
    """Per split: order, requested/observed ratio, rows; empty splits show 0 rows."""
    spark = df.sparkSession
    norm = normalise_ratios(ratios)
    dim = spark.createDataFrame(
        [(i + 1, n, float(r)) for i, (n, r) in enumerate(norm)],
        "split_order int, split string, requested_ratio double",
    )
    counts = df.groupBy(split_col).agg(F.count(F.lit(1)).alias("rows"))
    rep = F.broadcast(dim).join(counts, dim["split"] == counts[split_col], "left").select(
        dim["split_order"], dim["split"], dim["requested_ratio"], F.coalesce(counts["rows"], F.lit(0)).alias("rows")
    )
    total = F.sum("rows").over(Window.partitionBy())  # <= #splits rows
    return rep.select(
        "split_order",
        "split",
        F.round("requested_ratio", 6).alias("requested_ratio"),
        F.round(F.coalesce(F.try_divide(F.col("rows").cast("double"), total), F.lit(0.0)), 6).alias("observed_ratio"),
        F.col("rows").cast("long").alias("rows"),
        F.lit(requested).alias("strategy_requested"),
        F.lit(resolved).alias("strategy_resolved"),
        F.lit(fallback_reason is not None).alias("fallback"),
        F.lit(fallback_reason).cast("string").alias("fallback_reason"),
    )


def kfold_stratified(df: DataFrame, strat_col: str, k: int, seed: int = 42, key: str = ROW_ID,
                     out_col: str = "fold_id", purpose: str = "fold") -> DataFrame:
    """Round-robin stratified folds in hash order: ``(rank-1) % k + 1``.

    ``k`` is at most the size of the smallest class, so every fold has every class;
    a class with a single row leaves nothing to validate on and raises.
    """
    smallest = df.groupBy(strat_col).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).head()[0]
    k = k if smallest is None else min(k, int(smallest))
    if k < 2:
        raise ValueError("folds need at least two rows of each class, and two folds")
    x = df.withColumn("_rl_h", keyed_md5(seed, purpose, key))
    x = rank_by_hash(x, [strat_col], "_rl_h", key, rank_name="_rl_rank")
    return x.withColumn(out_col, ((F.col("_rl_rank") - 1) % k + 1).cast("int")).drop("_rl_h", "_rl_rank")


def holdout_inner(df: DataFrame, strat_col: str, group_col: str, fraction: float = 0.25,
                  seed: int = 42, key: str = ROW_ID, out_col: str = "inner_split") -> DataFrame:
    """Per outer fold: inner train/valid with ``fraction`` to valid, stratified by class."""
    x = df.withColumn("_rl_h", keyed_md5(seed, "inner", F.concat_ws(":", F.col(group_col).cast("string"), F.col(key).cast("string"))))
    x = rank_by_hash(x, [group_col, strat_col], "_rl_h", key, rank_name="_rl_rank", total_name="_rl_n")
    n_valid = F.ceil(F.col("_rl_n") * F.lit(fraction))
    return x.withColumn(
        out_col, F.when(F.col("_rl_rank") <= F.col("_rl_n") - n_valid, F.lit("train")).otherwise(F.lit("valid"))
    ).drop("_rl_h", "_rl_rank", "_rl_n")


def sample_n(df: DataFrame, n: int, seed: int = 42, key: str = ROW_ID) -> DataFrame:
    """Seeded sample of exactly ``n`` rows (all rows if fewer): top-n of a keyed hash."""
    return df.withColumn("_rl_h", keyed_md5(seed, "sample", key)).orderBy("_rl_h", key).limit(n).drop("_rl_h")

