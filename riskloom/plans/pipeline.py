"""Composable plans shared by the registered queries and the batch jobs.

``split_cohort``  -> cohort with ``split``, as a table: made once for all steps of a query
``scores_table``  -> long ``(model_name, split, row_id, y, p)`` scores
``prepared``      -> zero-as-missing -> median impute -> caps -> features
``fit_serving``   -> what serving needs: fitted medians, caps and the deployment threshold
``score_batch``   -> those applied to new rows, and the model's decision on each
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.config import (
    ALT_SCORERS,
    DEPLOYMENT_POLICY,
    FIXED_SCORER,
    POLICIES,
    RAW_NUMERICAL,
    TARGET,
    ZERO_AS_MISSING,
    LinearScorer,
)
from riskloom.operators import preprocess as pp
from riskloom.operators.features import feature_build
from riskloom.operators.inference import linear_score, predict
from riskloom.operators.policy import deployment_row, policy_select
from riskloom.operators.split import split_stratified
from riskloom.sources.cohort import cohort
from riskloom.sources.tables import shared_table


def split_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_table(split_stratified(shared_table(cohort(spark, sf_dir), "cohort"), TARGET), "split")


def all_scorers() -> list[LinearScorer]:
    return [FIXED_SCORER, *ALT_SCORERS]


def scores_table(spark: SparkSession, sf_dir: str, scorers: Sequence[LinearScorer] | None = None,
                 base: DataFrame | None = None) -> DataFrame:
    """Long scores table: one row per (model, row). Models are a generator over rows, not a join."""
    scorers = [FIXED_SCORER] if scorers is None else list(scorers)
    df = split_cohort(spark, sf_dir) if base is None else base
    arr = F.array(*[F.struct(F.lit(s.name).alias("m"), linear_score(s).alias("p")) for s in scorers])
    return df.select("split", "row_id", F.col(TARGET).alias("y"), F.explode(arr).alias("s")).select(
        F.col("s.m").alias("model_name"), "split", "row_id", "y", F.col("s.p").alias("p")
    )


def apply_prepared(df: DataFrame, fitted: dict) -> DataFrame:
    """Missing zeros imputed, values capped, features derived, all in one projection."""
    return feature_build(pp.transform_caps(pp.transform_impute_stat(df, fitted["medians"]), fitted["caps"]))


def prepared(spark: SparkSession, sf_dir: str, fit_splits: Sequence[str] | None = ("train",), rows: DataFrame | None = None) -> tuple[DataFrame, dict]:
    """Clean -> zeros to missing -> median impute -> caps -> derived features (fit on fit_splits); `rows`: the split cohort, if it is there."""
    df = split_cohort(spark, sf_dir) if rows is None else rows
    medians = pp.fit_impute_stat(df, ZERO_AS_MISSING, fit_splits)
    imputed = pp.transform_impute_stat(df, medians)
    caps = pp.fit_caps(imputed, RAW_NUMERICAL, fit_splits)
    fitted = {"medians": medians, "caps": caps}
    return apply_prepared(df, fitted), fitted


@dataclass(frozen=True)
class Serving:
    """Fitted on the training rows (medians, caps) and the validation rows (threshold)."""

    medians: dict
    caps: dict
    threshold: float
    scorer: LinearScorer

    def prepare(self, df: DataFrame) -> DataFrame:
        return apply_prepared(df, {"medians": self.medians, "caps": self.caps})

    def score(self, df: DataFrame) -> DataFrame:
        return predict(self.prepare(df), linear_score(self.scorer), threshold=self.threshold)


def fit_serving(spark: SparkSession, sf_dir: str, scorer: LinearScorer = FIXED_SCORER, rows: DataFrame | None = None) -> Serving:
    """Fit the preparation, score the validation rows with it, and choose the deployment policy's threshold there."""
    rows, fitted = prepared(spark, sf_dir, rows=rows)
    validation = rows.filter(F.col("split") == "validation").select(
        F.lit(scorer.name).alias("model_name"), "row_id", F.col(TARGET).alias("y"), linear_score(scorer).alias("p"))
    chosen = deployment_row(policy_select(validation, ["model_name"], POLICIES), ["model_name"], DEPLOYMENT_POLICY, [x.name for x in POLICIES])
    row = chosen.select("threshold").head()
    return Serving(fitted["medians"], fitted["caps"], 0.5 if row is None else float(row["threshold"]), scorer)


def score_batch(spark: SparkSession, sf_dir: str, split: str = "test") -> tuple[DataFrame, Serving]:
    """The rows of a split through the fitted preparation, the model and the chosen threshold."""
    rows = split_cohort(spark, sf_dir)
    serving = fit_serving(spark, sf_dir, rows=rows)
    return serving.score(rows.filter(F.col("split") == split)), serving
