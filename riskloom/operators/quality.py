"""Data-quality expectations, contracts, freshness and drift.

All expectations of a suite compile to ONE aggregate (a single pass and a
single tiny shuffle); the long result table is produced with ``stack``.
A failed *critical* expectation raises on the driver after the pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.config import (
    FRESH_MAX_HOURS,
    FRESH_WARNING_HOURS,
    MIN_MINORITY_RATIO,
    MIN_ROWS_CLEAN,
    MIN_ROWS_PER_SPLIT,
    NUMERICAL_RANGES,
    PSI_BINS,
    PSI_MODERATE_MAX,
    PSI_STABLE_MAX,
    SPLIT_COL,
    TARGET_ALLOWED,
    WARN_SPLIT_ROWS_BELOW,
    ColumnRoles,
)
from riskloom.functions.expressions import relative_delta_pct
from riskloom.operators.quantiles import exact_quantiles

_RESULT_COLS = ["expectation", "column_name", "severity", "unexpected_count", "success"]


class ExpectationFailed(RuntimeError):
    pass


# Registry of extra expectations: name -> factory(column) -> (unexpected-row predicate)
EXPECTATIONS: dict = {}


def register_expectation(name: str, predicate_factory) -> None:
    """``predicate_factory(column_name) -> Column`` that is TRUE for an unexpected row."""
    EXPECTATIONS[name] = predicate_factory


def _stack(agg: DataFrame, specs: list[tuple[str, str, str, str, str]]) -> DataFrame:
    """specs: (expectation, column, severity, count_col, success_expr_sql)."""
    parts = ", ".join(
        f"'{e}', '{c}', '{s}', CAST(`{cnt}` AS BIGINT), ({ok})" for e, c, s, cnt, ok in specs
    )
    return agg.selectExpr(f"stack({len(specs)}, {parts}) AS ({', '.join(_RESULT_COLS)})")


def validate_clean(
    df: DataFrame,
    roles: ColumnRoles,
    ranges: dict[str, tuple[float, float]] = NUMERICAL_RANGES,
    allowed_target: Sequence[int] = TARGET_ALLOWED,
    min_rows: int = MIN_ROWS_CLEAN,
    extra: Sequence[tuple[str, str, str]] = (),
    raise_on_critical: bool = True,
) -> DataFrame:
    """Suite on the cleaned table; ``extra`` = (registered name, column, severity).

    A failed critical expectation raises, unless only the report is wanted.
    """
    target = roles.target[0]
    checked = [*roles.numerical, target]
    aggs, specs = [F.count(F.lit(1)).alias("_rows"), F.lit(0).alias("_zero")], []
    for c in checked:
        present = c in df.columns
        specs.append(("expect_column_exists", c, "critical", "_zero", "true" if present else "false"))
    for c in [x for x in checked if x in df.columns]:
        aggs.append(F.sum(F.col(c).isNull().cast("int")).alias(f"nn_{c}"))
        specs.append(("expect_not_null", c, "critical", f"nn_{c}", f"`nn_{c}` = 0"))
    for c, (lo, hi) in ranges.items():
        if c not in df.columns:
            continue
        bad = F.col(c).isNotNull() & ~F.col(c).between(lo, hi)
        aggs.append(F.sum(bad.cast("int")).alias(f"bt_{c}"))
        specs.append(("expect_between", c, "warning", f"bt_{c}", f"`bt_{c}` = 0"))
    specs.append(("expect_row_count", "*", "critical", "_rows", f"_rows >= {int(min_rows)}"))
    if target in df.columns:
        bad = F.col(target).isNotNull() & ~F.col(target).isin(*allowed_target)
        aggs.append(F.sum(bad.cast("int")).alias("ds_target"))
        specs.append(("expect_distinct_in_set", target, "critical", "ds_target", "ds_target = 0"))
    for i, (name, c, sev) in enumerate(extra):
        aggs.append(F.sum(EXPECTATIONS[name](c).cast("int")).alias(f"x{i}"))
        specs.append((name, c, sev, f"x{i}", f"x{i} = 0"))
    agg = df.agg(*aggs)
    # row_count spec reports the row count itself as "observed"
    out = _stack(agg, specs)
    return _raised(out) if raise_on_critical else out


def _raised(results: DataFrame) -> DataFrame:
    """The results, if no critical expectation failed (NULL counts as failed)."""
    failed = results.filter((F.col("severity") == "critical") & ~F.coalesce("success", F.lit(False))).collect()
    if failed:
        raise ExpectationFailed(f"critical expectations failed: {[(r[0], r[1]) for r in failed]}")
    return results


def validate_split(
    df: DataFrame,
    split_names: Sequence[str] = ("train", "validation", "test"),
    split_col: str = SPLIT_COL,
    min_rows: int = MIN_ROWS_PER_SPLIT,
    warn_below: int = WARN_SPLIT_ROWS_BELOW,
    raise_on_critical: bool = True,
) -> DataFrame:
    """Per split (plus all rows): marker column present, values in set, row-count minima.

    One ``groupBy(split)`` pass; absent splits appear with 0 rows via the
    split dimension (a generator, no join against data). A row without a marker is
    outside the set. A failed critical expectation raises, unless only the report is wanted.
    """
    names = list(split_names)
    exists = F.struct(F.lit("expect_column_exists").alias("expectation"), F.lit("critical").alias("severity"),
                      F.lit(0 if split_col in df.columns else 1).cast("long").alias("observed"), F.lit(split_col in df.columns).alias("success"))
    present = df.sparkSession.range(1).select(F.lit("all").alias("scope"), exists.alias("r")).select("scope", "r.*")
    if split_col not in df.columns:
        return _raised(present) if raise_on_critical else present
    counts = df.groupBy(F.col(split_col).alias("scope")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum((~F.coalesce(F.col(split_col).isin(*names), F.lit(False))).cast("int")).alias("bad_values"),
    )
    dim = df.sparkSession.createDataFrame([(n,) for n in names], "scope string")
    per = F.broadcast(dim).join(counts, "scope", "left").select(
        "scope", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("bad_values", F.lit(0)).alias("bad_values")
    )
    totals = counts.agg(F.lit("all").alias("scope"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("bad_values"), F.lit(0)).alias("bad_values"))
    both = per.unionByName(totals)
    rows_l = F.col("rows").cast("long")
    out = present.unionByName(both.select(
        "scope",
        F.explode(F.array(
            F.struct(F.lit("expect_values_in_set").alias("expectation"), F.lit("critical").alias("severity"),
                     F.col("bad_values").cast("long").alias("observed"), (F.col("bad_values") == 0).alias("success")),
            F.struct(F.lit("expect_row_count_min").alias("expectation"), F.lit("critical").alias("severity"),
                     rows_l.alias("observed"), (F.col("rows") >= min_rows).alias("success")),
            F.struct(F.lit("expect_row_count_warn").alias("expectation"), F.lit("warning").alias("severity"),
                     rows_l.alias("observed"), (F.col("rows") >= warn_below).alias("success")),
        )).alias("r"),
    ).select("scope", "r.*"))
    return _raised(out) if raise_on_critical else out


def minority_ratio(df: DataFrame, target: str, split_col: str = SPLIT_COL, min_ratio: float = MIN_MINORITY_RATIO) -> DataFrame:
    counts = df.groupBy(split_col, target).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(split_col)  # <= #classes rows per split
    share = counts.withColumn("share", F.col("n") / F.sum("n").over(w))
    out = share.groupBy(split_col).agg(F.min("share").alias("minority_ratio"), F.count(F.lit(1)).alias("n_classes"))
    return out.select(split_col, F.round("minority_ratio", 9).alias("minority_ratio"), "n_classes",
                      F.when(F.col("minority_ratio") < min_ratio, "warning").otherwise("ok").alias("status"))


def _dtype_name(t: str) -> str:
    return {"int": "integer"}.get(t, t)


def contract_report(df: DataFrame, roles: ColumnRoles) -> DataFrame:
    """Row per expected column (group, present, dtype, null ratio, status) + unexpected columns."""
    expected: dict[str, str] = {}
    for group, cols in (("target", roles.target), ("categorical", roles.categorical), ("numerical", roles.numerical),
                        ("encoded_categorical", roles.encoded_categorical)):
        for c in cols:
            expected.setdefault(c, group)
    dtypes = dict(df.dtypes)
    unexpected = sorted(set(df.columns) - set(expected))
    observed = [c for c in [*expected, *unexpected] if c in dtypes]
    agg = df.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(c).isNull().cast("long")).alias(f"n_{c}") for c in observed])
    specs = []
    for c, g in expected.items():
        present = c in dtypes
        specs.append((c, g, present, _dtype_name(dtypes[c]) if present else None, "ok" if present else "missing"))
    for c in unexpected:
        specs.append((c, "unexpected", True, _dtype_name(dtypes[c]), "unexpected"))
    rows = []
    for c, g, present, dt, status in specs:
        ratio = f"CASE WHEN _n = 0 THEN 0D ELSE round(`n_{c}` / CAST(_n AS DOUBLE), 9) END" if present else "0D"
        dt_sql = f"'{dt}'" if dt else "CAST(NULL AS STRING)"
        rows.append(f"'{c}', '{g}', {str(present).lower()}, {dt_sql}, {ratio}, '{status}'")
    return agg.selectExpr(
        f"stack({len(rows)}, {', '.join(rows)}) AS (column_name, contract_group, present, observed_dtype, null_ratio, contract_status)"
    )


def freshness_report(df: DataFrame, ts_col: str, as_of: str, group_col: str | None = None,
                     warn_hours: float = FRESH_WARNING_HOURS, max_hours: float = FRESH_MAX_HOURS) -> DataFrame:
    """Age of the newest record vs warn/max SLA: fresh / warning / stale (missing when no rows)."""
    keys = [group_col] if group_col else []
    agg = df.groupBy(*keys).agg(F.max(ts_col).alias("latest_ts"))
    latest = F.unix_seconds(F.col("latest_ts").cast("timestamp"))
    age = (F.unix_seconds(F.lit(as_of).cast("timestamp")) - latest) / F.lit(3600.0)
    status = (F.when(F.col("latest_ts").isNull(), "missing").when(age <= warn_hours, "fresh")
              .when(age <= max_hours, "warning").otherwise("stale"))
    return agg.select(*keys, latest.alias("latest_epoch"), F.round(age, 6).alias("age_hours"),
                      status.alias("freshness_status"))


def psi_edges(ref: DataFrame, features: Sequence[str], bins: int = PSI_BINS) -> dict[str, list[float]]:
    """Unique interior quantile edges of the reference rows (outer edges are -inf/+inf)."""
    probs = [i * (1.0 / bins) for i in range(bins + 1)]
    qs = exact_quantiles(ref, features, probs)
    out = {}
    for f in features:
        vals = qs[f]
        if vals[0] is None:
            out[f] = None
            continue
        interior = sorted(set(vals[1:-1]))
        out[f] = interior
    return out


def _bin_counts(values: DataFrame, features: Sequence[str], edges: dict[str, list[float]], split_col: str) -> DataFrame:
    """(split, feature_name, bin, n): each task counts its rows' values between the edges; missing ones are left out."""
    features, ends = list(features), {f: np.array(edges[f], np.float64) for f in features}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], np.ndarray] = {}
        for batch in batches:
            names = batch.column(split_col)
            for name in pc.unique(names).to_pylist():
                part = batch.filter(pc.equal(names, name))
                for f in features:
                    v = part.column(f).to_numpy(zero_copy_only=False)
                    n = np.bincount(np.searchsorted(ends[f], v[~np.isnan(v)], "right"), minlength=len(ends[f]) + 1)
                    total[name, f] = total.get((name, f), 0) + n
        rows = [(s, f, b, c) for (s, f), n in total.items() for b, c in enumerate(n.tolist()) if c]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)], names=["split", "feature_name", "bin", "n"])

    parts = values.mapInArrow(run, "split string, feature_name string, bin int, n long")
    return parts.groupBy(F.col("split").alias(split_col), "feature_name", "bin").agg(F.sum("n").alias("n"))


def drift_psi(df: DataFrame, features: Sequence[str], reference: str = "train",
              compare: Sequence[str] = ("validation", "test"), bins: int = PSI_BINS,
              split_col: str = SPLIT_COL, stable_max: float = PSI_STABLE_MAX,
              moderate_max: float = PSI_MODERATE_MAX) -> DataFrame:
    """PSI per (comparison split, feature) against reference-split quantile bins."""
    spark = df.sparkSession
    splits = [reference, *compare]
    scoped = df.filter(F.col(split_col).isin(*splits))
    edges = psi_edges(scoped.filter(F.col(split_col) == reference), features, bins)
    feats = [f for f in features if edges.get(f) is not None]
    values = scoped.select(split_col, *[F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")).alias(f) for f in feats])
    counts = _bin_counts(values, feats, edges, split_col)
    of = lambda f: F.struct(F.lit(f).alias("feature_name"), F.avg(f).alias("mean"), F.stddev_pop(f).alias("std"), F.count(f).alias("rows"))
    # one row a split, then one for each of its features
    stats = values.groupBy(split_col).agg(F.array(*[of(f) for f in feats]).alias("s")).select(split_col, F.explode("s").alias("s")).select(split_col, "s.*").filter("rows > 0")
    # dense (split, feature, bin) grid from the small dimension (features x bins)
    grid_rows = [(s, f, b) for s in splits for f in feats for b in range(len(edges[f]) + 1)]
    grid = spark.createDataFrame(grid_rows, f"{split_col} string, feature_name string, bin int")
    dense = F.broadcast(grid).join(counts, [split_col, "feature_name", "bin"], "left").fillna(0, ["n"])
    tot = Window.partitionBy(split_col, "feature_name")  # <= bins+1 rows per group
    ratio = dense.withColumn("r", F.greatest(F.col("n") / F.greatest(F.sum("n").over(tot), F.lit(1)), F.lit(1e-6)))
    ref_r = ratio.filter(F.col(split_col) == reference).select("feature_name", "bin", F.col("r").alias("rr"))
    cmp_r = ratio.filter(F.col(split_col).isin(*compare))
    psi = cmp_r.join(ref_r, ["feature_name", "bin"]).groupBy(split_col, "feature_name").agg(
        F.sum((F.col("r") - F.col("rr")) * F.log(F.col("r") / F.col("rr"))).alias("psi"))
    ref_s = stats.filter(F.col(split_col) == reference).select(
        "feature_name", F.col("mean").alias("reference_mean"), F.col("std").alias("reference_std"), F.col("rows").alias("ref_rows"))
    cmp_s = stats.filter(F.col(split_col).isin(*compare)).select(
        split_col, "feature_name", F.col("mean").alias("comparison_mean"), F.col("std").alias("comparison_std"))
    out = psi.join(cmp_s, [split_col, "feature_name"]).join(ref_s, "feature_name")
    label = F.when(F.col("psi") <= stable_max, "stable").when(F.col("psi") <= moderate_max, "monitor").otherwise("drift")
    return out.select(
        F.lit(reference).alias("reference_split"), F.col(split_col).alias("comparison_split"), "feature_name",
        F.round("reference_mean", 6).alias("reference_mean"), F.round("comparison_mean", 6).alias("comparison_mean"),
        F.round("reference_std", 6).alias("reference_std"), F.round("comparison_std", 6).alias("comparison_std"),
        F.round(relative_delta_pct(F.col("comparison_mean"), F.col("reference_mean")), 6).alias("mean_delta_pct"),
        F.round("psi", 8).alias("psi"), label.alias("drift_label"),
    )
