"""Trained model families on ``pyspark.ml`` and sigmoid (Platt) calibration.

Families: ``logistic`` (LogisticRegression, regParam = 1/(C*n)), ``gbt``
(GBTClassifier). Class weights come from :func:`class_weights` as a
``weightCol``. Scoring returns the long scores table used by every metric.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import metrics as M
from riskloom.operators.preprocess import class_weights


def train_model(train: DataFrame, features: Sequence[str], target: str, family: str = "logistic",
                params: dict | None = None, weighted: bool = True) -> PipelineModel:
    params = dict(params or {})
    data = train.select(*features, F.col(target).cast("double").alias("label"))
    if weighted:
        w = class_weights(train.select(target), target, "balanced").select(F.col("label").cast("double").alias("label"), "weight")
        data = data.join(F.broadcast(w), "label")  # one row per class
    asm = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    if family == "logistic":
        c = float(params.pop("C", 1.0))
        n = data.count()
        est = LogisticRegression(featuresCol="features", labelCol="label", regParam=1.0 / (c * max(n, 1)),
                                 elasticNetParam=float(params.pop("l1_ratio", 0.0)), maxIter=int(params.pop("max_iter", 100)),
                                 standardization=True, weightCol="weight" if weighted else None)
    elif family == "gbt":
        est = GBTClassifier(featuresCol="features", labelCol="label", maxDepth=int(params.pop("max_depth", 3)),
                            maxIter=int(params.pop("n_estimators", 50)), stepSize=float(params.pop("learning_rate", 0.1)),
                            subsamplingRate=float(params.pop("subsample", 1.0)), seed=42,
                            weightCol="weight" if weighted else None)
    else:
        raise ValueError(f"unsupported model family: {family}")
    if params:
        raise ValueError(f"unsupported parameters for {family}: {sorted(params)}")
    return Pipeline(stages=[asm, est]).fit(data)


def score_model(model: PipelineModel, df: DataFrame, name: str, target: str, keep: Sequence[str] = ("split", "row_id")) -> DataFrame:
    """Long scores table ``(model_name, keep..., y, p)`` from a fitted pipeline."""
    out = model.transform(df)
    p = F.round(vector_to_array(F.col("probability"))[1], 9)
    return out.select(F.lit(name).alias("model_name"), *keep, F.col(target).cast("int").alias("y"), p.alias("p"))


def platt_fit(scores: DataFrame, keys: Sequence[str] = ("model_name",)) -> DataFrame:
    """Prefit sigmoid calibration parameters per group: ``p' = sigmoid(a + b*logit(p))`` (cross-fitted: ``search.cross_fit``)."""
    cal = M.calibration_fit(M.to_cells(scores, list(keys)), list(keys))
    return cal.select(*keys, F.col("calibration_intercept").alias("a"), F.col("calibration_slope").alias("b"))


def platt_apply(scores: DataFrame, params: DataFrame, keys: Sequence[str] = ("model_name",)) -> DataFrame:
    """Apply calibration (params: one row per model -> broadcast)."""
    pc = F.least(F.greatest(F.col("p"), F.lit(1e-6)), F.lit(1 - 1e-6))
    z = F.col("a") + F.col("b") * F.log(pc / (1 - pc))
    return scores.join(F.broadcast(params), list(keys)).withColumn("p", F.round(1 / (1 + F.exp(-z)), 9)).drop("a", "b")
