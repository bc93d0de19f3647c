"""Exact quantiles (numpy 'linear' interpolation) without a single-task buffer.

Spark's exact ``percentile`` aggregate keeps every distinct value of a group
in one buffer — for a global quantile that is the whole column in one task.
Here the order statistics are located by histogram refinement instead:

1. one pass: numbers of values, of negative and of positive infinities, and
   the finite minimum and maximum per column (infinities are ranks at the two
   ends and never enter the arithmetic);
2. each refinement pass: finite values inside the still-open intervals are
   bucketed (equal-width buckets per interval); a task counts its own rows and sends
   (interval, bucket, count, minimum, maximum), added up with ``groupBy``; the bucket
   that holds the wanted rank gives the next interval by its own minimum and maximum;
3. an interval whose ends are equal is solved. Its two ends always fall into
   different buckets, so every pass narrows an open interval and the loop ends.

Every pass touches only bounded aggregates, so the result is exact at any
scale and skew (a hot value resolves as a zero-width interval).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _order_stats(n: int, q: float) -> tuple[int, int, float]:
    h = (n - 1) * q
    k = math.floor(h)
    return k, min(k + 1, n - 1), h - k


def _histogram(data: DataFrame, intervals: dict[str, list[tuple[float, float, int]]], buckets: int) -> DataFrame:
    """(t, b, c, mn, mx): values in bucket b of interval t, from each column's disjoint intervals (low, high, t) in ascending order."""
    names = list(intervals)
    bounds = [(np.array([x[0] for x in own]), np.array([x[1] for x in own]), np.array([x[2] for x in own])) for own in intervals.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [np.zeros(len(lo) * buckets, np.int64) for lo, _, _ in bounds]
        least = [np.full(len(lo) * buckets, np.inf) for lo, _, _ in bounds]
        most = [np.full(len(lo) * buckets, -np.inf) for lo, _, _ in bounds]
        for batch in batches:
            for k, (lo, hi, _) in enumerate(bounds):
                v = batch.column(k).to_numpy(zero_copy_only=False)
                v = v[~np.isnan(v)]
                at = np.searchsorted(lo, v, "right") - 1
                inside = (at >= 0) & (v <= hi[at])
                v, at = v[inside], at[inside]
                # halves keep differences of very large numbers finite
                b = np.floor((v / 2 - lo[at] / 2) / (hi[at] / 2 - lo[at] / 2) * (buckets - 1)).astype(np.int64)
                place = at * buckets + np.where(v == hi[at], buckets - 1, np.minimum(b, buckets - 2))
                count[k] += np.bincount(place, minlength=len(count[k]))
                np.minimum.at(least[k], place, v)
                np.maximum.at(most[k], place, v)
        for k, (_, _, ids) in enumerate(bounds):
            at = np.flatnonzero(count[k])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at // buckets], pa.int32()), pa.array(at % buckets, pa.int32()), pa.array(count[k][at]), pa.array(least[k][at]), pa.array(most[k][at])], names=["t", "b", "c", "mn", "mx"])

    parts = data.select(*names).mapInArrow(run, "t int, b int, c long, mn double, mx double")
    return parts.groupBy("t", "b").agg(F.sum("c").alias("c"), F.min("mn").alias("mn"), F.max("mx").alias("mx"))


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    *,
    buckets: int = 4096,
    persist: bool = False,
) -> dict[str, list[float | None]]:
    """``{column: [quantile(p) for p in probs]}``; NULL/NaN ignored; empty column -> None.

    Every pass reads ``df`` again: give a table, or ``persist`` what takes long to make and fits the memory.
    """
    cols = list(columns)
    data = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in cols])
    if persist:
        data = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        low, high = float("-inf"), float("inf")
        aggs = []
        for c in cols:
            finite = F.when((F.col(c) > low) & (F.col(c) < high), F.col(c))
            aggs += [F.count(c).alias(f"n_{c}"), F.count(F.when(F.col(c) == low, 1)).alias(f"neg_{c}"), F.count(F.when(F.col(c) == high, 1)).alias(f"pos_{c}"),
                     F.min(finite).alias(f"lo_{c}"), F.max(finite).alias(f"hi_{c}")]
        row = data.agg(*aggs).head()
        # open targets: (column, rank) -> [lo, hi, number of values below the interval]
        state: dict[tuple[str, int], list] = {}
        solved: dict[tuple[str, int], float] = {}
        plan: dict[str, list[tuple[int, int, float] | None]] = {}
        for c in cols:
            n, neg, pos = (int(row[f"{x}_{c}"]) for x in ("n", "neg", "pos"))
            plan[c] = [_order_stats(n, float(q)) if n else None for q in probs]
            for k in {k for st in plan[c] if st for k in st[:2]}:
                if k < neg or k >= n - pos:
                    solved[(c, k)] = low if k < neg else high
                else:
                    state[(c, k)] = [float(row[f"lo_{c}"]), float(row[f"hi_{c}"]), neg]
        while True:
            for t in [t for t in state if state[t][0] == state[t][1]]:
                solved[t] = state.pop(t)[0]
            if not state:
                break
            ids = {iv: i for i, iv in enumerate(dict.fromkeys((t[0], *v) for t, v in state.items()))}
            # intervals of a column are one, or buckets of one: they don't overlap
            open_: dict[str, list[tuple[float, float, int]]] = {}
            for (c, lo, hi, _), i in sorted(ids.items(), key=lambda x: x[0][1]):
                open_.setdefault(c, []).append((lo, hi, i))
            by_t: dict[int, list] = {}
            for r in _histogram(data, open_, buckets).collect():
                by_t.setdefault(r["t"], []).append((r["b"], r["c"], r["mn"], r["mx"]))
            for t, (lo, hi, below) in state.items():
                acc = below
                for _, c, mn, mx in sorted(by_t[ids[(t[0], lo, hi, below)]]):
                    if acc + c > t[1]:
                        state[t] = [float(mn), float(mx), acc]
                        break
                    acc += c
        out: dict[str, list[float | None]] = {}
        for c in cols:
            vals = []
            for st in plan[c]:
                if st is None:
                    vals.append(None)
                    continue
                k0, k1, frac = st
                a, b = solved[(c, k0)], solved[(c, k1)]
                vals.append(a if a == b or not frac else a + (b - a) * frac)
            out[c] = vals
        return out
    finally:
        if persist:
            data.unpersist()
