"""Streaming inference: request files -> validate -> prepare -> score -> append sink.

Stateless per micro-batch (no watermark needed): every arriving request row goes
through the same fitted preparation, model and threshold as the batch. Requests
that can't be scored stay in the output with the reason, so nothing is lost.
Ranking is a batch concern and is not done on the stream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.plans.pipeline import Serving


def request_schema(features: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField("row_id", T.LongType())] + [T.StructField(f, T.DoubleType()) for f in features])


def scored_stream(spark: SparkSession, source_dir: str, features: Sequence[str], serving: Serving) -> DataFrame:
    """Streaming DataFrame of all requests: row_id, accepted, reject_reason, and for accepted ones probability, decision and band."""
    requests = spark.readStream.schema(request_schema(features)).parquet(source_dir)
    bad = lambda test: F.array_join(F.array_compact(F.array(*[F.when(test(F.col(f)), F.lit(f)) for f in features])), ",")
    missing, negative = bad(lambda c: c.isNull() | F.isnan(c)), bad(lambda c: c < 0)
    reason = F.when(missing != "", F.concat(F.lit("missing:"), missing)).when(negative != "", F.concat(F.lit("negative:"), negative))
    scored = serving.score(requests.withColumn("reject_reason", reason))
    ok = F.col("reject_reason").isNull()
    return scored.select("row_id", ok.alias("accepted"), "reject_reason", *[F.when(ok, F.col(c)).alias(c) for c in ("prediction_proba", "prediction", "risk_band")])


def run_available_now(stream: DataFrame, sink_dir: str, checkpoint_dir: str) -> None:
    """Process everything available, append to a Parquet sink, stop (exactly-once via checkpoint)."""
    q = (stream.writeStream.format("parquet").option("path", sink_dir).option("checkpointLocation", checkpoint_dir)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
