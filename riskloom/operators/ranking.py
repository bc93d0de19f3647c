"""Distributed exact ranking.

A ``row_number() OVER (PARTITION BY y ORDER BY ...)`` on a binary target has
two window partitions, i.e. two tasks holding the whole table. Both helpers
below produce the same numbers as that window but spread the work evenly:

* :func:`rank_by_hash` — the order key is a uniform md5 digest, so its hex
  prefix is a bucket id that is monotone in the order. Rank = rows in
  earlier buckets of the same group (small count table, prefix sums) + the
  row number inside ``(group, bucket)``. :func:`label_by_hash` only needs what
  follows from the rank: most buckets have one label, so rows don't move.
* :func:`global_rank` — arbitrary (unique, tie-broken) sort keys. Spark's
  range partitioner splits the key space into balanced contiguous ranges;
  once written to the shared folder the per-range counts give offsets, and the
  position inside a range comes from ``monotonically_increasing_id``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.hashing import hex_prefix_int
from riskloom.sources.tables import shared_table

_BUCKET = "_rl_bucket"


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; the keys come from the left side."""
    named = right.select(*[F.col(k).alias(f"_rl_key_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(named[f"_rl_key_{k}"])
    return left.join(named, cond, how).drop(*[f"_rl_key_{k}" for k in keys])


def _bucket_offsets(x: DataFrame, part: Sequence[str]) -> DataFrame:
    """(part, bucket) with the rows in it (_rl_c), in the group's buckets before it (_rl_off) and in the group (_rl_n)."""
    counts = x.groupBy(*part, _BUCKET).agg(F.count(F.lit(1)).alias("_rl_c"))
    by_group = Window.partitionBy(*part) if part else Window.partitionBy()
    before = by_group.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("*", F.coalesce(F.sum("_rl_c").over(before), F.lit(0)).alias("_rl_off"), F.sum("_rl_c").over(by_group).alias("_rl_n"))


def label_by_hash(
    df: DataFrame,
    part_cols: Sequence[str],
    hash_col: str,
    tie_col: str,
    label_of: Callable[[Column, Column], Column],
    *,
    label_name: str,
    digits: int = 4,
) -> DataFrame:
    """``label_of(rank, rows of the group)`` for the rank of :func:`rank_by_hash`; it has to be monotone in the rank.

    A bucket whose first and last rank have one label gives it to all its rows in place. Only the few
    buckets that a change of label falls into are ordered. ``df`` is read three times: give a table.
    """
    part = list(part_cols)
    x = df.withColumn(_BUCKET, hex_prefix_int(F.col(hash_col), digits))
    first, last = (label_of(F.col("_rl_off") + k, F.col("_rl_n")) for k in (F.lit(1), F.col("_rl_c")))
    offsets = _bucket_offsets(x, part).select(*part, _BUCKET, "_rl_off", "_rl_n", F.when(first == last, first).alias("_rl_label"))
    found = null_safe_join(x, shared_table(offsets, "labels"), [*part, _BUCKET])
    inner = Window.partitionBy(*part, _BUCKET).orderBy(F.col(hash_col), F.col(tie_col))
    mixed = found.filter(F.col("_rl_label").isNull()).withColumn("_rl_rn", F.row_number().over(inner))
    mixed = mixed.withColumn("_rl_label", label_of(F.col("_rl_off") + F.col("_rl_rn"), F.col("_rl_n"))).drop("_rl_rn")
    out = found.filter(F.col("_rl_label").isNotNull()).unionByName(mixed)
    return out.withColumn(label_name, F.col("_rl_label")).drop(_BUCKET, "_rl_off", "_rl_n", "_rl_label")


def rank_by_hash(
    df: DataFrame,
    part_cols: Sequence[str],
    hash_col: str,
    tie_col: str,
    *,
    rank_name: str = "rank",
    total_name: str | None = None,
    digits: int = 4,
) -> DataFrame:
    """Rank rows inside ``part_cols`` by ``(hash_col, tie_col)`` ascending.

    ``hash_col`` must hold lowercase hex digests (md5). A NULL in ``part_cols``
    is a group of its own. ``df`` is read twice: give a table. The count table
    has at most groups x 16**digits rows and is written, so the optimizer knows
    its size and broadcasts it if that is small.
    """
    part = list(part_cols)
    x = df.withColumn(_BUCKET, hex_prefix_int(F.col(hash_col), digits))
    offsets = _bucket_offsets(x, part).select(*part, _BUCKET, "_rl_off", *([F.col("_rl_n").alias(total_name)] if total_name else []))
    offsets = shared_table(offsets, "offsets")
    inner = Window.partitionBy(*part, _BUCKET).orderBy(F.col(hash_col), F.col(tie_col))
    x = x.withColumn("_rl_rn", F.row_number().over(inner))
    out = null_safe_join(x, offsets, [*part, _BUCKET])
    out = out.withColumn(rank_name, (F.col("_rl_off") + F.col("_rl_rn")).cast("long"))
    return out.drop(_BUCKET, "_rl_off", "_rl_rn")


def global_rank(
    df: DataFrame,
    order_cols: Sequence[Column],
    *,
    rank_name: str = "rank",
    num_ranges: int | None = None,
) -> DataFrame:
    """1-based rank over the whole table by ``order_cols`` (must be unique).

    Callers append a unique tie-breaker (``row_id``) so that ties on a hot
    value are still split across ranges.
    """
    spark = df.sparkSession
    n = num_ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = (
        df.repartitionByRange(n, *order_cols)
        .sortWithinPartitions(*order_cols)
        .withColumn("_rl_range", F.spark_partition_id())
        .withColumn("_rl_mid", F.monotonically_increasing_id())
    )
    # the ids are fixed on shared storage, so a lost executor cannot
    # re-derive a different range layout
    x = shared_table(x, "ranges")
    stats = x.groupBy("_rl_range").agg(
        F.count(F.lit(1)).alias("_rl_c"), F.min("_rl_mid").alias("_rl_m0")
    )
    before = Window.orderBy("_rl_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range (<= n rows): a bounded broadcast
    stats = stats.select(
        "_rl_range",
        "_rl_m0",
        F.coalesce(F.sum("_rl_c").over(before), F.lit(0)).alias("_rl_off"),
    )
    out = x.join(F.broadcast(stats), "_rl_range")
    out = out.withColumn(
        rank_name, (F.col("_rl_off") + F.col("_rl_mid") - F.col("_rl_m0") + 1).cast("long")
    )
    return out.drop("_rl_range", "_rl_mid", "_rl_m0", "_rl_off")
