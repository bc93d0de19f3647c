"""Small relational composites: tagged unions, configuration matching, feature bundles, prioritised fallbacks."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_NUMBERS = (*_INTEGERS, T.FloatType, T.DoubleType, T.DecimalType)


def common_type(types: Sequence[T.DataType]) -> T.DataType:
    """What columns of these types are widened to: the type itself, long, double, timestamp, else text."""
    known = [t for t in types if not isinstance(t, T.NullType)]
    if not known:
        return T.StringType()
    if all(t == known[0] for t in known):
        return known[0]
    if all(isinstance(t, _INTEGERS) for t in known):
        return T.LongType()
    if all(isinstance(t, _NUMBERS) for t in known):
        return T.DoubleType()
    if all(isinstance(t, (T.DateType, T.TimestampType)) for t in known):
        return T.TimestampType()
    return T.StringType()


def union_tagged(frames: Mapping[str, DataFrame | None], tag: str) -> DataFrame:
    """All frames' rows with the frame's name in column `tag`; a column that a frame has by that name is replaced.

    Columns are matched by name: absent ones are null, and those of different types are widened
    to a common one (:func:`common_type`). Columns are in the order of their first appearance, the tag last. Frames that are
    None count as absent; without any frame there is nothing to take a schema from.
    """
    present = {k: f for k, f in frames.items() if f is not None}
    if not present:
        raise ValueError("no frame to unite")
    types: dict[str, list[T.DataType]] = {}
    for f in present.values():
        for c in f.schema.fields:
            if c.name != tag:
                types.setdefault(c.name, []).append(c.dataType)
    wide = {c: common_type(ts) for c, ts in types.items()}

    def column(frame: DataFrame, name: str) -> Column:
        if name not in frame.columns:
            return F.lit(None).cast(wide[name]).alias(name)
        own = frame.schema[name].dataType
        value = F.col(f"`{name}`")
        if own != wide[name]:
            # structures and lists as text by their JSON
            value = F.to_json(value) if isinstance(wide[name], T.StringType) and isinstance(own, (T.StructType, T.ArrayType, T.MapType)) else value.cast(wide[name])
        return value.alias(name)

    out = None
    for name, frame in present.items():
        part = frame.select(*[column(frame, c) for c in wide], F.lit(name).alias(tag))
        out = part if out is None else out.unionByName(part)
    return out


# ------------------------------------------------------------ configurations
def _plain(value):
    if isinstance(value, dict):
        return {k: _plain(value[k]) for k in sorted(value)}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


def canonical_json(params: Column, defaults: Column) -> Column:
    """Text that equal configurations share: `params` over `defaults` (JSON objects), keys in order at every depth, numbers by value.

    A null or malformed object counts as empty: a configuration without parameters is its defaults.
    """

    def read(text) -> dict:
        try:
            found = json.loads(text) if isinstance(text, str) else {}
        except ValueError:
            found = {}
        return found if isinstance(found, dict) else {}

    @F.pandas_udf("string")
    def canonical(own: pd.Series, base: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(_plain({**read(b), **read(p)}), sort_keys=True) for p, b in zip(own, base, strict=True)])

    return canonical(params, defaults)


def config_match(wanted: DataFrame, candidates: DataFrame, order: str, class_col: str = "class_path", params: str = "params", defaults: str | None = None) -> DataFrame:
    """`wanted` with `matched` (the first candidate by `order` of the same class whose merged parameters are equal, or null) and `n_matches`.

    Candidates are reduced to one row a configuration before the join, so a configuration that many candidates share
    is one row there. A null class matches a null class.
    """
    base = F.col(defaults) if defaults else F.lit("{}")
    key = lambda df: df.withColumn("_config", canonical_json(F.col(params), base if not defaults or defaults in df.columns else F.lit("{}")))
    found = key(candidates).groupBy(F.col(class_col).alias("_class"), "_config").agg(F.min(order).alias("matched"), F.count(F.lit(1)).alias("n_matches"))
    own = key(wanted).alias("w")
    joined = own.join(found.alias("f"), F.col(f"w.{class_col}").eqNullSafe(F.col("f._class")) & (F.col("w._config") == F.col("f._config")), "left")
    return joined.select(*[F.col(f"w.`{c}`") for c in wanted.columns], "matched", F.coalesce("n_matches", F.lit(0)).alias("n_matches"))


# --------------------------------------------------------------------- bundle
def feature_bundle(frontiers: Mapping[str, DataFrame | None], winner: str, counts: Mapping[str, int], tag: str = "model_name") -> tuple[DataFrame, dict]:
    """The families' frontiers in one table with `selected_model_flag`, and the manifest of the winner (the first family if unknown)."""
    names = list(frontiers)
    known = winner if winner in names else names[0]
    table = union_tagged(frontiers, tag).withColumn("selected_model_flag", (F.col(tag) == winner).cast("int"))
    manifest = {
        "manifest_type": "feature_selection", "selection_scope": "per_model_family", "selected_model_name": winner, "features_from": known,
        "candidate_count": int(sum(counts.get(n, 0) for n in names)), "selected_model_candidate_count": int(counts.get(known, 0)),
        "per_model_counts": {n: int(counts.get(n, 0)) for n in names},
    }
    return table, manifest


# ----------------------------------------------------------- fallback chains
def first_rule(*rules: tuple[str, Column]) -> tuple[Column, Column]:
    """The first non-null value of (rule, value) pairs, and the name of its rule (null without one)."""
    value = F.coalesce(*[v for _, v in rules])
    name = None
    for rule, v in rules:
        name = F.when(v.isNotNull(), F.lit(rule)) if name is None else name.when(v.isNotNull(), F.lit(rule))
    return value, name


def _first_by(df: DataFrame, keys: Sequence[str], value: str, order: str, where: Column | None = None) -> DataFrame:
    rows = df if where is None else df.where(where)
    return rows.groupBy(*keys).agg(F.min_by(value, order).alias("_value"))


def selected_model_resolve(policies: DataFrame, frontier: DataFrame, keys: Sequence[str] = (), order: str = "rank") -> DataFrame:
    """`policies` (keys, model_name, class_path) with `selected_model_name` and `rule`, by the rows of `frontier` with the same keys.

    In turn: the policy's model if the frontier has it (policy_model), the first frontier model of the policy's class
    (class_path), the first marked for refitting (selected_for_refit); without frontier rows the policy's own model (policy_only).
    """
    keys = list(keys)
    k = [F.col(f"`{c}`") for c in keys]

    def same(a: str, b: str) -> Column:
        out = F.lit(True)
        for c in keys:
            out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
        return out

    names = frontier.select(*k, F.col("model_name").alias("_name")).distinct()
    classes = _first_by(frontier.where(F.col("class_path").isNotNull()), [*keys, "class_path"], "model_name", order).withColumnRenamed("_value", "_by_class")
    marked = _first_by(frontier, keys, "model_name", order, F.col("selected_for_refit")).withColumnRenamed("_value", "_marked")
    any_row = frontier.select(*k).distinct().withColumn("_any", F.lit(True)) if keys else frontier.limit(1).select(F.lit(True).alias("_any"))
    j = policies.alias("p").join(names.alias("n"), same("p", "n") & (F.col("p.model_name") == F.col("n._name")), "left").select("p.*", "_name")
    j = j.alias("p").join(classes.alias("c"), same("p", "c") & (F.col("p.class_path") == F.col("c.class_path")), "left").select("p.*", "_by_class")
    j = j.alias("p").join(marked.alias("m"), same("p", "m"), "left").select("p.*", "_marked")
    j = j.alias("p").join(any_row.alias("a"), same("p", "a"), "left").select("p.*", "_any")
    value, rule = first_rule(("policy_model", F.col("_name")), ("class_path", F.col("_by_class")), ("selected_for_refit", F.col("_marked")),
                             ("policy_only", F.when(F.col("_any").isNull(), F.col("model_name"))))
    return j.select(*policies.columns, value.alias("selected_model_name"), rule.alias("rule"))


def active_policy_row(metrics: DataFrame, keys: Sequence[str], active: str | Column | None, order: str = "policy_order", policy_col: str = "policy_name") -> DataFrame:
    """For each group the first row (by `order`) of the active policy, else its first row, with `rule` (active or first)."""
    keys = list(keys)
    wanted = F.lit(active) if isinstance(active, str) or active is None else active
    hit = F.coalesce(F.col(policy_col) == wanted, F.lit(False))
    # the smallest of (not the active policy, place): a partial aggregate, whatever a group's size
    rows = F.struct(*[F.col(f"`{c}`") for c in metrics.columns])
    best = metrics.groupBy(*keys).agg(F.min_by(F.struct(rows.alias("row"), hit.alias("hit")), F.struct((~hit).cast("int"), F.col(order))).alias("_b"))
    return best.select("_b.row.*", F.when(F.col("_b.hit"), "active").otherwise("first").alias("rule"))


def diagnostic_threshold(selected: Column, configured: Column, fresh: Column) -> tuple[Column, Column]:
    """The deployed threshold, else the policy's configured one, else the one chosen afresh; and which it is."""
    return first_rule(("selected", selected), ("configured", configured), ("fresh", fresh))
