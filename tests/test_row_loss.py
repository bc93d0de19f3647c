"""Rows and groups with NULL keys, infinities, and degenerate calibration inputs."""

import math

import numpy as np
import pytest

from riskloom.operators import metrics as M
from riskloom.operators import robustness as R
from riskloom.operators.features import AbsentColumns, select_roles
from riskloom.operators.quantiles import exact_quantiles
from riskloom.operators.split import split_stratified
from riskloom.config import RAW_ROLES


def test_null_stratum_keeps_its_rows(spark):
    rows = [(i, None if i % 10 == 0 else i % 2) for i in range(100)]
    out = split_stratified(spark.createDataFrame(rows, "row_id long, y int"), "y")
    assert out.count() == 100 and out.where("y is null and split is not null").count() == 10


def test_null_group_keeps_its_metrics(spark):
    rows = [(m, i % 2, 0.2 + 0.06 * (i % 10)) for m in ("a", None) for i in range(40)]
    scores = spark.createDataFrame(rows, "model_name string, y int, p double")
    got = {r.model_name: r for r in M.metric_payload(scores, ["model_name"], 0.5).collect()}
    assert set(got) == {"a", None} and got["a"].roc_auc == got[None].roc_auc and got[None].calibration_slope is not None


@pytest.mark.parametrize("extra", [[math.inf], [-math.inf, math.inf], [1e300, -1e300], [1.7e308, -1.7e308], [5.0] * 3000, []])
def test_quantiles_of_any_spread(spark, extra):
    values = np.random.default_rng(0).normal(size=2000).tolist() + extra + [None, math.nan]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    probs = [0.0, 0.01, 0.5, 0.77, 0.99]
    got = exact_quantiles(df, ["v"], probs, buckets=64)["v"]
    ordered = np.sort([v for v in values if v is not None and not math.isnan(v)])
    for q, g in zip(probs, got):
        h = (len(ordered) - 1) * q
        a, b = ordered[math.floor(h)], ordered[min(math.floor(h) + 1, len(ordered) - 1)]
        want = a if a == b or h == math.floor(h) else a + (b - a) * (h - math.floor(h))
        assert g == want or abs(g - want) <= 1e-12 * max(abs(want), abs(a))


def fitted(spark, rows):
    scores = spark.createDataFrame([("m", y, p) for y, p in rows], "model_name string, y int, p double")
    return M.calibration_fit(M.to_cells(scores, ["model_name"]), ["model_name"]).head()


def test_calibration_of_confident_wrong_scores(spark):
    low, high = 1e-6, 1 - 1e-6
    r = fitted(spark, [(1, low)] * 20 + [(0, low)] + [(0, high)] * 20 + [(1, high)])
    assert r.converged and abs(r.calibration_slope - math.log(1 / 20) / math.log(high / low)) < 1e-4 and abs(r.calibration_intercept) < 1e-6


def test_calibration_of_separable_scores_is_finite(spark):
    r = fitted(spark, [(0, 0.2)] * 10 + [(1, 0.7)] * 10)
    assert r.converged and 1 < r.calibration_slope < 1e3
    one = fitted(spark, [(1, 0.2), (1, 0.7)])
    assert (one.calibration_slope, one.calibration_intercept) == (1.0, 0.0)


def test_perturbation_labels(spark):
    def label(*labels):
        rows = [("m", "f", 0.1 * i, "up", x, 0.1, 0.1, 0.1, 0.0, 0.0) for i, x in enumerate(labels)]
        cols = "model_name string, feature_name string, perturbation_pct double, direction string, sensitivity_label string, mean_sensitivity_ratio double, "
        cols += "max_sensitivity_ratio double, mean_abs_probability_delta double, decision_flip_rate double, risk_band_change_rate double"
        return R.perturbation_summary(spark.createDataFrame(rows, cols)).head().overall_label

    assert label("too_sensitive", "proportional") == "too_sensitive"
    assert label("too_insensitive", "proportional") == "too_insensitive"
    assert label("too_sensitive", "too_insensitive") == "mixed"
    assert label("proportional") == "proportional"


def test_absent_columns_are_named(spark):
    with pytest.raises(AbsentColumns, match="Glucose"):
        select_roles(spark.range(1), RAW_ROLES)
