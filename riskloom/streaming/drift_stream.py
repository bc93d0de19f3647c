"""Streaming drift: per event-time window, counts of scored values by reference bin, then PSI.

The stream keeps one state row for each open (window, group, bin): its size follows the
number of windows within the watermark's delay, not the rows. A window is appended once, when
the watermark passes its end; rows later than that are dropped, as in any watermarked
aggregate, and counted by Spark's `numRowsDroppedByWatermark`. The batch function makes the same counts of the
closed windows, so a stream without rows beyond the delay gives the same table.

Missing values are in no bin, and no window is there for missing event times.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.config import PSI_BINS, PSI_MODERATE_MAX, PSI_STABLE_MAX
from riskloom.operators.quality import psi_edges

WINDOW, DELAY = "1 day", "1 hour"


def reference_edges(reference: DataFrame, value: str, bins: int = PSI_BINS) -> list[float]:
    """Interior quantile edges of the reference rows; without any value there is one bin."""
    return [float(e) for e in psi_edges(reference, [value], bins)[value] or []]


def bin_of(value: Column, edges: Sequence[float]) -> Column:
    """Number of edges at or below the value."""
    if not edges:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= value))


def _counts(rows: DataFrame, time: str, value: str, edges: Sequence[float], group: str, window: str) -> DataFrame:
    present = rows.where(F.col(value).isNotNull() & ~F.isnan(value) & F.col(time).isNotNull())
    keyed = present.groupBy(F.window(F.col(time), window).alias("w"), F.col(group).alias("group"), bin_of(F.col(value), edges).alias("bin"))
    return keyed.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "group", "bin", "n")


def stream_counts(spark: SparkSession, source: str, schema: T.StructType, time: str, value: str, edges: Sequence[float], group: str, window: str = WINDOW, delay: str = DELAY, files: int | None = None) -> DataFrame:
    """Streaming DataFrame (window_start, window_end, group, bin, n) of the windows that the watermark has closed."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    # a watermark needs a timestamp with a zone; one without is taken in the session's
    rows = reader.parquet(source).withColumn(time, F.col(time).cast("timestamp"))
    return _counts(rows.withWatermark(time, delay), time, value, edges, group, window)


def batch_counts(rows: DataFrame, time: str, value: str, edges: Sequence[float], group: str, window: str = WINDOW, delay: str = DELAY) -> DataFrame:
    """The same counts of all rows, for the windows that end at or before the latest time less the delay."""
    rows = rows.withColumn(time, F.col(time).cast("timestamp"))
    last = rows.agg((F.max(time) - F.expr(f"interval {delay}")).alias("_closed"))
    counts = _counts(rows, time, value, edges, group, window)
    return counts.join(F.broadcast(last), F.col("window_end") <= F.col("_closed")).drop("_closed")  # one row


def run_available_now(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Everything that is there, appended to a Parquet sink, exactly once by the checkpoint."""
    query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def window_psi(counts: DataFrame, reference: DataFrame, value: str, edges: Sequence[float], group: str, floor: float = 1e-6, stable_max: float = PSI_STABLE_MAX, moderate_max: float = PSI_MODERATE_MAX) -> DataFrame:
    """PSI of each (window, group) against the reference rows' shares of the bins; bins without rows count as `floor`."""
    bins = F.explode(F.sequence(F.lit(0), F.lit(len(edges))))
    ref = reference.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(F.col(group).alias("group"), bin_of(F.col(value), edges).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    own = [F.col(c) for c in ("window_start", "window_end", "group")]

    def shares(rows: DataFrame, keys: list[Column], name: str) -> DataFrame:
        dense = rows.select(*keys).distinct().withColumn("bin", bins).withColumn("n", F.lit(0).cast("long"))
        full = rows.select(*keys, "bin", "n").unionByName(dense).groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
        total = F.sum("n").over(Window.partitionBy(*keys))  # a row for each bin
        return full.select(*keys, "bin", "n", F.greatest(F.col("n") / F.greatest(total, F.lit(1)), F.lit(floor)).alias(name))

    compared = shares(counts, own, "share").alias("c")
    base = shares(ref, [F.col("group")], "base").drop("n").alias("r")
    j = compared.join(base, F.col("c.group").eqNullSafe(F.col("r.group")) & (F.col("c.bin") == F.col("r.bin")))
    psi = j.groupBy("window_start", "window_end", F.col("c.group").alias("group")).agg(
        F.sum("n").alias("rows"), F.sum((F.col("share") - F.col("base")) * F.log(F.col("share") / F.col("base"))).alias("psi"))
    label = F.when(F.col("psi") <= stable_max, "stable").when(F.col("psi") <= moderate_max, "monitor").otherwise("drift")
    return psi.select("window_start", "window_end", F.col("group").alias(group), "rows", F.round("psi", 8).alias("psi"), label.alias("drift_label"))
