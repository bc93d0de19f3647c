import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.config import POLICIES
from riskloom.operators import metrics as M
from riskloom.operators import policy as P


def _scores(spark, rows):
    return spark.createDataFrame(rows, "model_name string, y int, p double")


def brute_auc(rows):
    pos = [p for _, y, p in rows if y == 1]
    neg = [p for _, y, p in rows if y == 0]
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in itertools.product(pos, neg))
    return s / (len(pos) * len(neg))


def test_auc_matches_pairwise_with_ties(spark):
    rows = [("m", i % 2, round((i * 37 % 11) / 10.0, 1)) for i in range(60)]
    got = M.roc_auc(M.to_cells(_scores(spark, rows), ["model_name"]), ["model_name"]).head()["roc_auc"]
    assert got == pytest.approx(brute_auc(rows), abs=1e-9)


def test_auc_single_class_is_null(spark):
    rows = [("m", 1, 0.2), ("m", 1, 0.7)]
    assert M.roc_auc(M.to_cells(_scores(spark, rows), ["model_name"]), ["model_name"]).head()["roc_auc"] is None


def test_calibration_identity_and_single_class(spark):
    rows = [("a", 1, 0.9), ("a", 1, 0.8)]
    r = M.calibration_fit(M.to_cells(_scores(spark, rows), ["model_name"]), ["model_name"]).head()
    assert (r["calibration_slope"], r["calibration_intercept"]) == (1.0, 0.0)


def test_threshold_metrics_reproduce_manifest_counts(spark):
    # policy fixture: tn/fp/fn/tp 49/14/14/21 -> accuracy .714, precision/recall/f1 .600, cost 28
    rows = [("m", 0, 0.1)] * 49 + [("m", 0, 0.9)] * 14 + [("m", 1, 0.1)] * 14 + [("m", 1, 0.9)] * 21
    r = M.threshold_metrics(_scores(spark, rows), ["model_name"], 0.5).head()
    assert (r["tn"], r["fp"], r["fn"], r["tp"]) == (49, 14, 14, 21)
    assert round(r["accuracy"], 3) == 0.714 and round(r["precision"], 3) == 0.6 and round(r["recall"], 3) == 0.6
    assert round(r["f1"], 3) == 0.6 and r["expected_cost"] == 28


def test_empty_group_safe_division(spark):
    m = M.derive_threshold_metrics(
        spark.createDataFrame([(0.0, 0.0, 0.0, 0.0, 0.0, 0.0)], "tn double, fp double, fn double, tp double, _n double, _sum_p double"), [])
    assert m.head()["precision"] == 0.0 and m.head()["mean_risk_score"] == 0.0


def test_threshold_grid():
    g = P.grid_values()
    assert len(g) == 17 and g[0] == 0.1 and g[-1] == 0.9 and g[14] == 0.8


def test_sweep_equals_direct_counts(spark):
    rows = [("m", i % 3 == 0, (i % 19) / 19.0) for i in range(200)]
    s = spark.createDataFrame([(a, int(b), c) for a, b, c in rows], "model_name string, y int, p double")
    sweep = {r["threshold"]: r for r in P.threshold_sweep(s, ["model_name"]).collect()}
    for t in P.grid_values():
        direct = M.threshold_metrics(s, ["model_name"], t).head()
        assert (sweep[t]["tp"], sweep[t]["fp"], sweep[t]["tn"], sweep[t]["fn"]) == (direct["tp"], direct["fp"], direct["tn"], direct["fn"])


def test_policy_select_min_cost_brute_force(spark):
    rows = [("m", int(i % 4 == 0), ((i * 7) % 23) / 23.0) for i in range(300)]
    s = spark.createDataFrame(rows, "model_name string, y int, p double")
    sel = {r["policy_name"]: r for r in P.policy_select(s, ["model_name"], POLICIES).collect()}
    pol = next(p for p in POLICIES if p.name == "prioritize_recall")
    cands = []
    for t in P.grid_values():
        tp = sum(1 for _, y, p in rows if y == 1 and p >= t)
        fp = sum(1 for _, y, p in rows if y == 0 and p >= t)
        fn = sum(1 for _, y, p in rows if y == 1 and p < t)
        rec = tp / (tp + fn) if tp + fn else 0.0
        fnr = fn / (fn + tp) if fn + tp else 0.0
        cands.append((not rec >= pol.min_recall, fn * pol.fn_cost + fp * pol.fp_cost, fnr, -rec, t))
    assert math.isclose(sel["prioritize_recall"]["threshold"], min(cands)[4])
    assert sel["default_050"]["threshold"] == 0.5


def _calibration(y, p, w):
    """Penalised Newton on single scores."""
    x, b = np.log(p / (1 - p)), np.zeros(2)
    design = np.column_stack([np.ones(len(x)), x])
    for _ in range(60):
        s = 1 / (1 + np.exp(-(design @ b)))
        gradient = design.T @ (w * (y - s)) - np.array([0, b[1] / M.CALIBRATION_C])
        hessian = (design * (w * s * (1 - s))[:, None]).T @ design + np.diag([0, 1 / M.CALIBRATION_C])
        b = b + np.linalg.solve(hessian, gradient)
    return b


def test_resamples_against_numpy(spark):
    from riskloom.operators import robustness as R

    rng = np.random.default_rng(8)
    n, k = 3000, 6
    p = {"a": rng.beta(2, 3, n).round(2).clip(0.001, 0.999), "b": rng.random(n)}  # many ties, and none
    y = (rng.random(n) < p["a"]).astype(int)
    rows = [(m, i, int(y[i]), float(p[m][i])) for m in p for i in range(n)]
    scores = spark.createDataFrame(rows, "model_name string, row_id long, y int, p double").repartition(5)
    got = {(r.model_name, r.iteration): r for r in R.bootstrap_metrics(scores, k, 0.4, 8.0, 1.0).collect()}
    w = R.poisson_weights(list(range(n)), k)
    assert len(got) == 2 * k and abs(w.mean() - 1) < 0.05 and (w[:, 0] != w[:, 1]).any()
    for (m, it), r in got.items():
        weight, q = w[:, it - 1].astype(float), p[m].round(9)
        hit = q >= 0.4
        tp, fp, fn, tn = (weight[a].sum() for a in ((y == 1) & hit, (y == 0) & hit, (y == 1) & ~hit, (y == 0) & ~hit))
        pos, neg = np.bincount(np.unique(q, return_inverse=True)[1], weight * y), np.bincount(np.unique(q, return_inverse=True)[1], weight * (1 - y))
        auc = (pos * (np.cumsum(neg) - neg / 2)).sum() / (pos.sum() * neg.sum())
        a, b = _calibration(y, q, weight)
        expected = {"roc_auc": auc, "brier": (weight * (q - y) ** 2).sum() / weight.sum(), "log_loss": -(weight * np.log(np.where(y == 1, q, 1 - q))).sum() / weight.sum(),
                    "recall": tp / (tp + fn), "precision": tp / (tp + fp), "false_positive_rate": fp / (fp + tn), "expected_cost": 8 * fn + fp,
                    "calibration_slope_error": abs(b - 1), "calibration_intercept_abs": abs(a)}
        for name, value in expected.items():
            assert abs(r[name] - value) < 1e-7 * max(1, abs(value)), (m, it, name)
