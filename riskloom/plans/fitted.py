"""One fitted pipeline: a chain of parameter tables from raw rows to calibrated decisions.

Imputation, caps, derived features, one-hot encoding, standard scaling and a linear model
(calibrated or not) are parameters, not objects: fitting returns them, serving is a
projection over them, and saving writes them as tables. `fit_splits=None` refits
everything on all splits, as production does.

A saved version is a folder of tables that nobody reads until a row of the manifest names
it; the row is written last, by one commit, so a reader sees a version whole or not at all,
and one that failed half-way never.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.config import CATEGORY_ORDERS, DERIVED_NUMERICAL, FIXED_SCORER, RAW_NUMERICAL, RISK_BANDS, ZERO_AS_MISSING, LinearScorer
from riskloom.functions.expressions import sigmoid
from riskloom.operators import impute_knn as knn
from riskloom.operators import preprocess as pp
from riskloom.operators.features import feature_build
from riskloom.operators.inference import linear_score, predict
from riskloom.plans.search import CrossFitted

NUMERICAL = [*RAW_NUMERICAL, *DERIVED_NUMERICAL]
PARAMETERS = "step string, name string, position int, number double, text string"


@dataclass(frozen=True)
class FittedPipeline:
    """Fitted parameters by step; `models` are regressions with their sigmoids (a, b), or one without."""

    medians: dict[str, float | None] = field(default_factory=dict)
    caps: dict[str, tuple] = field(default_factory=dict)
    categories: dict[str, list[str]] = field(default_factory=dict)
    scales: dict[str, tuple[float, float]] = field(default_factory=dict)
    models: tuple[tuple[LinearScorer, float, float], ...] = ((FIXED_SCORER, 0.0, 1.0),)
    threshold: float = 0.5
    policy: str = ""
    fit_splits: tuple[str, ...] | None = ("train",)
    imputer: knn.KnnImputer | None = None
    #: whether the model reads encoded and scaled columns, or the prepared ones
    encoded: bool = True

    # ------------------------------------------------------------------ serve
    def prepare(self, df: DataFrame) -> DataFrame:
        """Imputed, capped rows with the derived features."""
        imputed = pp.transform_impute_stat(df, self.medians) if self.imputer is None else knn.transform_impute_knn(df, self.imputer)
        return feature_build(pp.transform_caps(imputed, self.caps))

    def transform(self, df: DataFrame) -> DataFrame:
        """What the model reads: categories one-hot, numerical columns scaled."""
        rows = self.prepare(df)
        return pp.transform_standard(pp.transform_onehot(rows, self.categories), self.scales) if self.encoded else rows

    def features(self) -> list[str]:
        return [*NUMERICAL, *pp.onehot_columns(self.categories)]

    def probability(self):
        """Mean of the sigmoids over the models' probabilities; a single model without calibration as it is."""
        if len(self.models) == 1 and self.models[0][1:] == (0.0, 1.0):
            return linear_score(self.models[0][0])
        out = F.lit(0.0)
        for scorer, a, b in self.models:
            p = F.least(F.greatest(linear_score(scorer), F.lit(1e-6)), F.lit(1 - 1e-6))
            out = out + sigmoid(F.lit(float(a)) + F.lit(float(b)) * F.log(p / (1 - p)))
        return F.round(out / len(self.models), 9)

    def score(self, df: DataFrame) -> DataFrame:
        """`df` as prepared, with prediction_proba, risk_score, risk_band and prediction."""
        if not self.encoded:
            return predict(self.prepare(df), self.probability(), threshold=self.threshold, bands=RISK_BANDS)
        own = self.prepare(df)
        kept = [c for c in own.columns if c not in self.categories]
        # the model's columns beside the ones that a report shows
        wide = own.select("*", *[F.col(c).alias(f"_shown_{c}") for c in own.columns])
        read = pp.transform_standard(pp.transform_onehot(wide, self.categories), self.scales)
        scored = predict(read, self.probability(), threshold=self.threshold, bands=RISK_BANDS)
        made = ["prediction_proba", "risk_score", "risk_band", "prediction"]
        return scored.select(*[F.col(f"_shown_{c}").alias(c) for c in [*kept, *self.categories]], *made)

    def with_model(self, fitted: CrossFitted, name: str = "regression", threshold: float | None = None, policy: str | None = None) -> FittedPipeline:
        models = tuple((fitted.fits[k].scorer(name), a, b) for k, a, b in fitted.chain)
        return replace(self, models=models, encoded=True, threshold=self.threshold if threshold is None else threshold, policy=self.policy if policy is None else policy)

    # ------------------------------------------------------------- parameters
    def parameters(self, spark: SparkSession) -> DataFrame:
        """All parameters as rows (step, name, position, number, text)."""
        rows: list[tuple] = [("impute", c, 0, m, None) for c, m in self.medians.items()]
        if self.imputer is not None:
            rows += [("knn", c, i, v, None) for c in self.imputer.columns for i, v in enumerate(self.imputer.scales[c])]
            rows += [("knn_mean", c, 0, m, None) for c, m in zip(self.imputer.columns, self.imputer.means, strict=True)]
            rows += [("knn_k", "k", 0, float(self.imputer.k), "zero_missing" if self.imputer.zero_missing else None)]
        rows += [("cap", c, i, v, None) for c, pair in self.caps.items() for i, v in enumerate(pair)]
        rows += [("onehot", c, i, None, v) for c, values in self.categories.items() for i, v in enumerate(values)]
        rows += [("scale", c, i, v, None) for c, pair in self.scales.items() for i, v in enumerate(pair)]
        for k, (scorer, a, b) in enumerate(self.models):
            rows += [("intercept", scorer.name, k, scorer.intercept, str(scorer.round_digits)), ("sigmoid_a", scorer.name, k, float(a), None), ("sigmoid_b", scorer.name, k, float(b), None)]
            rows += [("weight", c, k, w, str(i)) for i, (c, w) in enumerate(scorer.weights)]
        rows += [("threshold", self.policy, 0, self.threshold, None), ("encoded", "encoded", 0, float(self.encoded), None)]
        rows += [("fit_splits", "fit_splits", 0, None, None if self.fit_splits is None else json.dumps(list(self.fit_splits)))]
        return spark.createDataFrame([(s, n, p, None if v is None else float(v), t) for s, n, p, v, t in rows], PARAMETERS)


def from_parameters(rows: Sequence, donors: DataFrame | None = None) -> FittedPipeline:
    """The pipeline of parameter rows (their number follows the columns, not the data)."""
    by: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["step"], r["position"], int(r["text"]) if r["step"] == "weight" else 0)):
        by.setdefault(r["step"], []).append(r)

    def pairs(step: str) -> dict[str, tuple]:
        out: dict[str, tuple] = {}
        for r in by.get(step, []):
            out[r["name"]] = (*out.get(r["name"], ()), r["number"])
        return out

    categories: dict[str, list[str]] = {}
    for r in by.get("onehot", []):
        categories.setdefault(r["name"], []).append(r["text"])
    models = []
    for r in by["intercept"]:
        k = r["position"]
        weights = tuple((w["name"], w["number"]) for w in by.get("weight", []) if w["position"] == k)
        a, b = (next(x["number"] for x in by[s] if x["position"] == k) for s in ("sigmoid_a", "sigmoid_b"))
        models.append((LinearScorer(r["number"], weights, r["name"], int(r["text"])), a, b))
    imputer = None
    if "knn" in by:
        scales = pairs("knn")
        means = {r["name"]: r["number"] for r in by["knn_mean"]}
        imputer = knn.KnnImputer(tuple(scales), scales, tuple(means[c] for c in scales), donors, int(by["knn_k"][0]["number"]), by["knn_k"][0]["text"] is not None)
    splits = by["fit_splits"][0]["text"]
    return FittedPipeline(
        {r["name"]: r["number"] for r in by.get("impute", [])}, pairs("cap"), categories, pairs("scale"), tuple(models), by["threshold"][0]["number"], by["threshold"][0]["name"],
        None if splits is None else tuple(json.loads(splits)), imputer, bool(by["encoded"][0]["number"]))


# ------------------------------------------------------------------------ fit
def fit_preparation(df: DataFrame, fit_splits: Sequence[str] | None = ("train",), imputer: str = "median") -> FittedPipeline:
    """Every fitted step on the rows of `fit_splits` (None: all rows), each on the output of the one before."""
    if imputer not in ("median", "knn"):
        raise ValueError(f"unknown imputer: {imputer}")
    rows = pp.fit_rows(df, fit_splits)
    fitted = FittedPipeline(fit_splits=None if fit_splits is None else tuple(fit_splits))
    if imputer == "knn":
        fitted = replace(fitted, imputer=knn.fit_impute_knn(rows, ZERO_AS_MISSING, None))
        imputed = knn.transform_impute_knn(rows, fitted.imputer)
    else:
        fitted = replace(fitted, medians=pp.fit_impute_stat(rows, ZERO_AS_MISSING, None))
        imputed = pp.transform_impute_stat(rows, fitted.medians)
    fitted = replace(fitted, caps=pp.fit_caps(imputed, RAW_NUMERICAL, None))
    built = feature_build(pp.transform_caps(imputed, fitted.caps))
    return replace(fitted, categories=pp.fit_onehot(built, list(CATEGORY_ORDERS), None), scales=pp.fit_standard(built, NUMERICAL, None))


# ----------------------------------------------------------------- save, load
def save(fitted: FittedPipeline, spark: SparkSession, path: str) -> str:
    """Write a version under `path`, then publish it; returns its name."""
    version = uuid.uuid4().hex
    folder = f"{path.rstrip('/')}/versions/{version}"
    fitted.parameters(spark).coalesce(1).write.parquet(f"{folder}/parameters")
    if fitted.imputer is not None:
        fitted.imputer.donors.write.parquet(f"{folder}/donors")
    row = spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("published_at"), F.lit(fitted.policy).alias("policy"),
                                F.lit(float(fitted.threshold)).alias("threshold"), F.lit(fitted.imputer is not None).alias("has_donors"))
    row.coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/manifest")
    return version


def versions(spark: SparkSession, path: str) -> DataFrame:
    """The published versions, newest first."""
    return spark.read.parquet(f"{path.rstrip('/')}/manifest").orderBy(F.desc("published_at"), "version")


def load(spark: SparkSession, path: str, version: str | None = None) -> FittedPipeline:
    """A published version, the newest if none is named."""
    listed = versions(spark, path)
    row = (listed if version is None else listed.where(F.col("version") == version)).head()
    if row is None:
        raise LookupError(f"no published version{'' if version is None else ' ' + version} under {path}")
    folder = f"{path.rstrip('/')}/versions/{row.version}"
    donors = spark.read.parquet(f"{folder}/donors") if row.has_donors else None
    return from_parameters(spark.read.schema(PARAMETERS).parquet(f"{folder}/parameters").collect(), donors)
