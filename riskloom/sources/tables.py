"""Table readers and writers (Parquet / CSV / JSON)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.config import RAW_NUMERICAL, TARGET
from riskloom.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (``<sf_dir>/<name>.parquet``); scans prune columns/filters."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def raw_schema(numerical=RAW_NUMERICAL, target=TARGET, as_string: bool = False) -> T.StructType:
    """Explicit schema for the raw clinical CSV; no inference pass over the data."""
    num_t = T.StringType() if as_string else T.DoubleType()
    fields = [T.StructField(c, num_t, True) for c in numerical]
    fields.append(T.StructField(target, T.StringType() if as_string else T.IntegerType(), True))
    return T.StructType(fields)


def scan_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed CSV read with header; malformed cells become NULL (PERMISSIVE)."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def latest_version_read(spark: SparkSession, path: str, version_col: str = "version") -> DataFrame:
    """Newest ``version=<v>`` partition of a dataset written with ``partitionBy(version)``.

    Finding the newest version reads no data column, only the partition values;
    the filter on the partition column is then pruned at planning time.
    """
    df = spark.read.parquet(path)
    latest = df.select(F.max(version_col)).head()[0]
    return df.filter(F.col(version_col) == F.lit(latest))


def json_manifest(df: DataFrame) -> DataFrame:
    """Rows -> one JSON array of records (``[]`` for an empty table).

    For small report tables only (policy catalogue, scorecard); large tables
    are written with ``df.write.json`` instead.
    """
    return df.agg(
        F.coalesce(
            F.to_json(F.collect_list(F.struct(*[F.col(c) for c in df.columns]))), F.lit("[]")
        ).alias("manifest_json")
    )


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the session's shared folder: computed once, and still there after an executor is lost."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/tables-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
