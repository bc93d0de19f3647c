"""Append-only registries (runs / experiments / models) and request payloads.

A registry is a table with an id, an ``updated_at`` and a JSON payload.
Upsert = union of old and new versions, keep the newest per id. The newest
row per id is chosen with ``max_by`` — a partial (map-side) aggregate — so a
single id holding a large share of the rows never lands in one window task.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.session import ensure_checkpoint_dir


def registry_upsert(old: DataFrame, new: DataFrame, id_col: str, order_cols: Sequence[str]) -> DataFrame:
    """Insert-or-replace by ``id_col``: newest by ``order_cols`` (lexicographic) wins."""
    both = old.unionByName(new)
    others = [c for c in both.columns if c != id_col]
    key = F.struct(*[F.col(c) for c in order_cols])
    latest = both.groupBy(id_col).agg(F.max_by(F.struct(*[F.col(c) for c in others]), key).alias("_r"))
    return latest.select(id_col, "_r.*")


def registry_lookup(reg: DataFrame, id_col: str, ids: Sequence, error_col: str | None = None) -> DataFrame:
    """Rows for the requested ids; an error text is reduced to its first line, trimmed."""
    out = reg.filter(F.col(id_col).isin(*ids))
    if error_col:
        out = out.withColumn(error_col, F.trim(F.element_at(F.split(F.col(error_col), "\n"), 1)))
    return out


def registry_recent(reg: DataFrame, ts_col: str, n: int, payload_col: str | None = None,
                    payload_schema: str | None = None, tie_col: str | None = None) -> DataFrame:
    """Last ``n`` entries by ``ts_col`` desc (top-k: TakeOrderedAndProject), payload parsed."""
    order = [F.col(ts_col).desc()] + ([F.col(tie_col).desc()] if tie_col else [])
    out = reg.orderBy(*order).limit(n)
    if payload_col and payload_schema:
        out = out.withColumn("payload", F.from_json(F.col(payload_col), payload_schema))
    return out


def payload_to_table(payloads: DataFrame, json_col: str, schema: T.StructType) -> DataFrame:
    """JSON object or array of objects per row -> one table row per object (empty -> no rows)."""
    arr_t = T.ArrayType(schema)
    as_array = F.when(F.trim(F.col(json_col)).startswith("["), F.from_json(F.col(json_col), arr_t)).otherwise(
        F.array(F.from_json(F.col(json_col), schema)))
    return payloads.select(F.inline(as_array))


def payload_validate(payloads: DataFrame, json_col: str, required: Sequence[str], key_cols: Sequence[str] = ()) -> DataFrame:
    """Split request records into accepted / rejected with a reason.

    Rejected when a required field is missing or not numeric, an extra field
    is present, or a value is negative.
    """
    req = F.array(*[F.lit(r) for r in required])
    # an object is parsed once: what is read several times has a projection of its own
    parsed = payloads.select(*key_cols, F.from_json(F.col(json_col), "map<string,string>").alias("_rl_vals"))
    vals = F.col("_rl_vals")
    keys = F.coalesce(F.map_keys(vals), F.array().cast("array<string>"))
    numbers = F.array(*[F.element_at(vals, r).try_cast("double") for r in required])
    found = parsed.select("*", keys.alias("_rl_keys"), numbers.alias("_rl_numbers"))
    missing, extra = F.array_except(req, F.col("_rl_keys")), F.array_except(F.col("_rl_keys"), req)
    number = lambda i: F.get(F.col("_rl_numbers"), i)
    non_numeric = F.filter(req, lambda k, i: number(i).isNull() | F.isnan(number(i)))
    negative = F.filter(req, lambda k, i: number(i) < 0)
    reason = (
        F.when(vals.isNull(), F.lit("malformed"))
        .when(F.size(missing) > 0, F.concat(F.lit("missing:"), F.array_join(F.array_sort(missing), ",")))
        .when(F.size(extra) > 0, F.concat(F.lit("extra:"), F.array_join(F.array_sort(extra), ",")))
        .when(F.size(non_numeric) > 0, F.concat(F.lit("non_numeric:"), F.array_join(non_numeric, ",")))
        .when(F.size(negative) > 0, F.concat(F.lit("negative:"), F.array_join(negative, ",")))
    )
    judged = found.select("*", reason.alias("_rl_reason"))
    nums = [number(F.lit(i)).alias(r) for i, r in enumerate(required)]
    return judged.select(*key_cols, *nums, F.col("_rl_reason").isNull().alias("accepted"), F.col("_rl_reason").alias("reject_reason"))


def sink_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory (a scratch folder only with a local master)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "riskloom-sinks", f"{name}-{uuid.uuid4().hex}")


def file_inventory(spark: SparkSession, path_glob: str) -> DataFrame:
    """path, size_bytes, modified_at of files (content column pruned by the binaryFile source)."""
    return spark.read.format("binaryFile").load(path_glob).select(
        F.col("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))
