"""Scoring, prediction decoding and the ranked risk report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.config import (
    NEGATIVE_LABEL,
    NO_BAND_LABEL,
    POSITIVE_LABEL,
    RISK_BANDS,
    ROW_ID,
    LinearScorer,
)
from riskloom.functions.expressions import decide, recommended_action, risk_band, sigmoid
from riskloom.operators.ranking import global_rank


def linear_score(scorer: LinearScorer):
    """Column expression of a fixed logistic scorer (rounded to its digits)."""
    z = F.lit(float(scorer.intercept))
    for f, wgt in scorer.weights:
        z = z + F.lit(float(wgt)) * F.col(f)
    return F.round(sigmoid(z), scorer.round_digits)


def predict(df: DataFrame, proba, threshold: float = 0.5,
            bands: Sequence[tuple[str, str, float, float]] | None = RISK_BANDS,
            band_default: str | None = None) -> DataFrame:
    """Add prediction_proba, risk_score, risk_band (when bands are configured) and prediction."""
    out = df.withColumn("prediction_proba", proba)
    out = out.withColumn("risk_score", F.col("prediction_proba") * F.lit(100.0))
    if bands:
        out = out.withColumn("risk_band", risk_band("prediction_proba", bands, band_default))
    return out.withColumn("prediction", decide("prediction_proba", threshold))


def risk_report(scored: DataFrame, policy_name: str, threshold: float, source_cols: Sequence[str],
                key: str = ROW_ID) -> DataFrame:
    """User-facing ranked report.

    case_id numbers rows 1..n in input (``row_id``) order; risk_priority_rank
    orders by probability descending, ties by input order. Both ranks are
    computed by :func:`global_rank` (range partitions), never by a
    single-partition window.
    """
    has_band = "risk_band" in scored.columns
    base = scored.select(
        key, *source_cols, "prediction", "prediction_proba", "risk_score",
        *(["risk_band"] if has_band else []),
    )
    with_case = global_rank(base, [F.col(key).asc()], rank_name="case_id")
    ranked = global_rank(with_case, [F.col("prediction_proba").desc(), F.col(key).asc()], rank_name="risk_priority_rank")
    band = F.col("risk_band") if has_band else F.lit(None).cast("string")
    return ranked.select(
        "case_id", key, *source_cols,
        "prediction",
        F.when(F.col("prediction").cast("string") == "1", F.lit(POSITIVE_LABEL)).otherwise(F.lit(NEGATIVE_LABEL)).alias("prediction_label"),
        "prediction_proba", "risk_score", band.alias("risk_band"),
        F.lit(policy_name).alias("decision_policy_name"),
        F.lit(float(threshold)).alias("decision_threshold"),
        recommended_action(band).alias("recommended_action"),
        "risk_priority_rank",
    )


def risk_band_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy(F.coalesce(F.col("risk_band"), F.lit(NO_BAND_LABEL)).alias("risk_band")).agg(
        F.count(F.lit(1)).alias("n_cases")
    )
