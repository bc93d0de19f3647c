"""DuckDB SQL of the search, calibration, refit, bundle, fallback and drift queries."""

from __future__ import annotations

from oracle_queries import (
    _TS,
    _THR,
    BAND_SQL,
    BRIER,
    CATS,
    CELLS,
    DERIVED,
    RAW,
    SC_ALL,
    SC_FIXED,
    ZM,
    _feat_select,
    calib_ctes,
    counts_at,
    policy_sql,
    thr_metrics_from_counts,
    with_base,
)

SQL: dict[str, str] = {}

# ------------------------------------------------------------------- search
# The search spaces, as (parameter, kind, low, high, log | choices)
_FLOATS = {
    "optimized": [("depth", "int", 3, 10), ("iterations", "int", 100, 500), ("learning_rate", "log", 0.01, 0.3), ("l2_leaf_reg", "log", 1.0, 20.0),
                  ("random_strength", "float", 0.0, 5.0), ("bagging_temperature", "float", 0.0, 5.0), ("border_count", "int", 32, 255)],
    "xgboost": [("n_estimators", "int", 100, 700), ("max_depth", "int", 2, 10), ("learning_rate", "log", 0.01, 0.3), ("min_child_weight", "int", 1, 10),
                ("subsample", "float", 0.6, 1.0), ("colsample_bytree", "float", 0.6, 1.0), ("reg_alpha", "float", 0.0, 10.0), ("reg_lambda", "log", 0.5, 20.0), ("gamma", "float", 0.0, 5.0)],
}
_COMBOS = ["l2__lbfgs", "l2__liblinear", "l2__saga", "l2__newton-cg", "l1__liblinear", "l1__saga", "elasticnet__saga", "none__lbfgs", "none__newton-cg", "none__saga"]


def _u(family: str, name: str) -> str:
    return f"(('0x' || substr(md5(concat('42:{family}:{name}:', CAST(trial AS VARCHAR))), 1, 12))::BIGINT / 281474976710656.0::DOUBLE)"


def _number(family: str, name: str, kind: str, low, high) -> str:
    u = _u(family, name)
    if kind == "int":
        return f"least({low} + floor({u} * {high - low + 1}), {high})::DOUBLE"
    if kind == "log":
        return f"exp(ln({low}::DOUBLE) + {u} * (ln({high}::DOUBLE) - ln({low}::DOUBLE)))"
    return f"({low}::DOUBLE + {u} * ({high}::DOUBLE - {low}::DOUBLE))"


_ROWS = [f"SELECT '{f}' AS family, trial, '{n}' AS parameter, round({_number(f, n, k, lo, hi)}, 9) AS number, NULL::VARCHAR AS choice FROM tr"
         for f, ps in _FLOATS.items() for n, k, lo, hi in ps]
_COMBO = "[" + ", ".join(f"'{c}'" for c in _COMBOS) + f"][least(floor({_u('baseline', 'solver_penalty_combo')} * 10), 9)::INT + 1]"
_ROWS += [
    "SELECT 'baseline', trial, 'solver_penalty_combo', NULL, combo FROM ba",
    f"SELECT 'baseline', trial, 'C', round({_number('baseline', 'C', 'log', 0.0005, 200.0)}, 9), NULL FROM ba WHERE combo NOT LIKE 'none%'",
    f"SELECT 'baseline', trial, 'l1_ratio', round({_number('baseline', 'l1_ratio', 'float', 0.05, 0.95)}, 9), NULL FROM ba WHERE combo = 'elasticnet__saga'",
    f"SELECT 'baseline', trial, 'fit_intercept', NULL, ['true', 'false'][least(floor({_u('baseline', 'fit_intercept')} * 2), 1)::INT + 1] FROM ba",
]
_ROWS += [f"SELECT '{f}', trial, 'cv_folds', least(5, n0, n1)::DOUBLE, NULL FROM tr, cc" for f in ("baseline", "optimized", "xgboost")]
_ROWS += ["SELECT 'xgboost', trial, 'scale_pos_weight', round(CASE WHEN n1 > 0 THEN n0 / n1 ELSE 1.0 END, 9), NULL FROM tr, cc"]
SQL["search_trials"] = with_base(
    " UNION ALL ".join(_ROWS), "tr AS (SELECT range::INT AS trial FROM range(1, 61))", f"ba AS (SELECT trial, {_COMBO} AS combo FROM tr)",
    "cc AS (SELECT count(*) FILTER (WHERE Outcome = 0) AS n0, count(*) FILTER (WHERE Outcome = 1) AS n1 FROM spl WHERE split = 'train')")

# -------------------------------------------------------------- calibration
_FOLDS = ("fo AS (SELECT row_id, CAST((row_number() OVER (PARTITION BY Outcome ORDER BY md5(concat('42:fold:', CAST(row_id AS VARCHAR))), row_id) - 1) % 5 + 1 AS INTEGER) AS fold_id "
          "FROM spl WHERE split = 'train')")
_PLATT = [
    SC_FIXED, _FOLDS,
    "pc AS (SELECT fold_id, y, round(LEAST(GREATEST(p, 1e-6), 1 - 1e-6), 9) AS p, count(*) * 1.0::DOUBLE AS w FROM sc JOIN fo USING (row_id) GROUP BY ALL)",
    "pn AS (SELECT fold_id, sum(CASE WHEN y = 1 THEN w ELSE 0 END) AS n1, sum(CASE WHEN y = 0 THEN w ELSE 0 END) AS n0 FROM pc GROUP BY fold_id)",
    "ps AS (SELECT fold_id, p, w, CASE WHEN y = 1 THEN (n1 + 1) / (n1 + 2) ELSE 1 / (n0 + 2) END AS t FROM pc JOIN pn USING (fold_id))",
    "cells AS (SELECT fold_id, 1 AS y, p, w * t AS w FROM ps UNION ALL SELECT fold_id, 0, p, w * (1 - t) FROM ps)",
    *calib_ctes("fold_id", "cells", 12),
]
SQL["calibrate_crossfit"] = with_base(
    "SELECT row_id, round(avg(1 / (1 + exp(-(calibration_intercept + calibration_slope * ln(q / (1 - q)))))), 7) AS p "
    "FROM (SELECT row_id, LEAST(GREATEST(p, 1e-6), 1 - 1e-6) AS q FROM sc WHERE split = 'test') t CROSS JOIN cal GROUP BY row_id", *_PLATT)

# ------------------------------------------------------------------- nested
SQL["nested_parts"] = with_base(
    "SELECT a AS audited_fold, CASE WHEN outer_fold = a THEN 'outer_test' WHEN quarter = 1 THEN 'inner_validation' ELSE 'inner_train' END AS role, "
    "count(*) AS rows, sum(Outcome)::BIGINT AS positives FROM nq, (SELECT unnest([1, 2, 3]) AS a) GROUP BY ALL",
    "nf AS (SELECT *, CAST((row_number() OVER (PARTITION BY Outcome ORDER BY md5(concat('42:outer:', CAST(row_id AS VARCHAR))), row_id) - 1) % 3 + 1 AS INTEGER) AS outer_fold "
    "FROM spl WHERE split IN ('train', 'validation'))",
    "nq AS (SELECT *, CAST((row_number() OVER (PARTITION BY outer_fold, Outcome ORDER BY md5(concat('42:quarter:', CAST(row_id AS VARCHAR))), row_id) - 1) % 4 + 1 AS INTEGER) AS quarter FROM nf)")

# ------------------------------------------------------------ refit and save
_ALL = [
    "zm AS (SELECT * REPLACE (" + ", ".join(f"NULLIF({c}, 0) AS {c}" for c in ZM) + ") FROM spl)",
    "med AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in ZM) + " FROM zm)",
    "imp AS (SELECT zm.* REPLACE (" + ", ".join(f"COALESCE({c}, m_{c}) AS {c}" for c in ZM) + ") FROM zm CROSS JOIN med)",
    "capq AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.05) AS lo_{c}, quantile_cont({c}, 0.95) AS hi_{c}" for c in RAW) + " FROM imp)",
    "caps AS (SELECT " + ", ".join(f"lo_{c} - 1.5*(hi_{c}-lo_{c}) AS l_{c}, hi_{c} + 1.5*(hi_{c}-lo_{c}) AS u_{c}" for c in RAW) + " FROM capq)",
    "capped AS (SELECT imp.* REPLACE (" + ", ".join(f"LEAST(GREATEST({c}, l_{c}), u_{c}) AS {c}" for c in RAW) + ") FROM imp CROSS JOIN caps)",
    "feat AS (" + _feat_select("capped") + ")",
]
_ORDER = {
    "age_category": ["mature", "senior"], "bmi_category": ["underweight", "healthy", "overweight", "obese"], "glucose_category": ["normal", "prediabetes", "diabetes"],
    "age_bmi_category": [f"{b}_{a}" for b in ("underweight", "healthy", "overweight", "obese") for a in ("mature", "senior")],
    "age_glucose_category": [f"{g}_{a}" for g in ("low", "normal", "hidden", "high") for a in ("mature", "senior")], "insulin_category": ["normal", "abnormal"],
}
SQL["refit_production"] = with_base(
    " UNION ALL ".join(
        [f"SELECT 'impute' AS step, '{c}' AS name, 0 AS position, round(m_{c}, 6) AS number, NULL::VARCHAR AS text FROM med" for c in ZM]
        + [f"SELECT 'cap', '{c}', {i}, round({e}_{c}, 6), NULL FROM caps" for c in RAW for i, e in enumerate("lu")]
        + [f"SELECT 'scale', '{c}', 0, round(avg({c}), 6), NULL FROM feat" for c in RAW + DERIVED]
        + [f"SELECT 'scale', '{c}', 1, round(CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END, 6), NULL FROM feat" for c in RAW + DERIVED]
        + [f"SELECT 'onehot', '{c}', {i}, NULL::DOUBLE, '{v}'" for c in CATS for i, v in enumerate(_ORDER[c])]), *_ALL)
SQL["artifact_save_load"] = with_base(
    f"SELECT row_id, p AS prediction_proba, {_THR} AS decision_threshold, CAST(p >= {_THR} AS INTEGER) AS prediction, " + BAND_SQL.format(d="NULL") + " AS risk_band FROM ts", *_TS)

# -------------------------------------------------------- bundles, fallbacks
_FRONT = [SC_ALL, "c AS (" + counts_at("0.5") + ")", CELLS, BRIER,
          "fr AS (SELECT t.*, bl.brier, bl.log_loss FROM (" + thr_metrics_from_counts("c", "model_name, split") + ") t JOIN bl USING (model_name, split) WHERE split <> 'test')"]
SQL["union_tagged"] = with_base(
    "SELECT row_id::BIGINT AS row_id, round(Glucose::DOUBLE, 6) AS Glucose, Outcome::INT AS Outcome, NULL::DOUBLE AS BMI, 'train' AS split FROM spl WHERE split = 'train' "
    "UNION ALL SELECT row_id, round(Glucose::FLOAT::DOUBLE, 6), NULL, round(BMI, 6), 'validation' FROM spl WHERE split = 'validation'")
SQL["feature_bundle"] = with_base(
    "SELECT model_name, split, brier, CASE WHEN model_name = 'fixed_logistic' THEN log_loss END AS log_loss, CASE WHEN model_name = 'bmi_age_preg' THEN recall END AS recall, "
    "tp::DOUBLE AS tp, CAST(model_name = (SELECT model_name FROM fr WHERE split = 'validation' ORDER BY brier, model_name LIMIT 1) AS INT) AS selected_model_flag, 6 AS candidate_count FROM fr", *_FRONT)
SQL["config_match"] = """
SELECT a.p_partkey AS wanted, min(b.p_partkey) AS matched, count(b.p_partkey) AS n_matches
FROM part a LEFT JOIN part b ON a.p_brand IS NOT DISTINCT FROM b.p_brand AND a.p_size = b.p_size AND a.p_type = b.p_type
WHERE a.p_partkey % 10 = 0 GROUP BY a.p_partkey
"""
SQL["selected_model_resolve"] = """
WITH f AS (SELECT o_custkey AS k, 'm' || (o_orderkey % 7) AS model_name, 'c' || (o_orderkey % 5) AS class_path, o_orderkey % 3 = 0 AS refit, o_orderkey AS r FROM orders),
p AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 <> 0 THEN 'm' || (c_custkey % 7) END AS model_name, CASE WHEN c_custkey % 3 <> 0 THEN 'c' || (c_custkey % 5) END AS class_path FROM customer),
j AS (SELECT p.k, p.model_name, (SELECT count(*) FROM f WHERE f.k = p.k) AS n, (SELECT min(f.model_name) FROM f WHERE f.k = p.k AND f.model_name = p.model_name) AS a,
      (SELECT arg_min(f.model_name, f.r) FROM f WHERE f.k = p.k AND f.class_path = p.class_path) AS b, (SELECT arg_min(f.model_name, f.r) FROM f WHERE f.k = p.k AND f.refit) AS c FROM p)
SELECT k AS custkey, COALESCE(a, b, c, CASE WHEN n = 0 THEN model_name END) AS selected_model_name,
       CASE WHEN a IS NOT NULL THEN 'policy_model' WHEN b IS NOT NULL THEN 'class_path' WHEN c IS NOT NULL THEN 'selected_for_refit' WHEN n = 0 AND model_name IS NOT NULL THEN 'policy_only' END AS rule
FROM j
"""
SQL["active_policy_row"] = with_base(
    "SELECT model_name, w.wanted, policy_name, threshold, CASE w.wanted WHEN 'absent' THEN 'first' ELSE 'active' END AS rule FROM pol, (SELECT unnest(['prioritize_recall', 'absent']) AS wanted) w "
    "WHERE policy_name = CASE w.wanted WHEN 'absent' THEN 'default_050' ELSE w.wanted END", SC_ALL, *policy_sql())
SQL["diagnostic_threshold"] = with_base(
    "SELECT model_name, policy_name, CASE WHEN model_name = 'fixed_logistic' AND policy_name = 'prioritize_recall' THEN threshold WHEN policy_name = 'default_050' THEN 0.5 ELSE threshold END AS diagnostic_threshold, "
    "CASE WHEN model_name = 'fixed_logistic' AND policy_name = 'prioritize_recall' THEN 'selected' WHEN policy_name = 'default_050' THEN 'configured' ELSE 'fresh' END AS rule FROM pol", SC_ALL, *policy_sql())

# -------------------------------------------------------------------- stream
SQL["drift_stream"] = """
WITH ev AS (SELECT ts, event_type, value FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND ts IS NOT NULL),
ref AS (SELECT * FROM ev WHERE ts < TIMESTAMP '2024-01-08 00:00:00'),
ed AS (SELECT list_sort(list_distinct(quantile_cont(value, [0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9]))) AS e FROM ref),
bi AS (SELECT unnest(range(0, len(e) + 1)) AS bin FROM ed),
b AS (SELECT event_type, len(list_filter(e, lambda x: x <= value)) AS bin, date_trunc('day', ts) AS d, ts < TIMESTAMP '2024-01-08 00:00:00' AS is_ref FROM ev, ed),
rt AS (SELECT event_type, count(*) AS n FROM b WHERE is_ref GROUP BY 1),
rs AS (SELECT t.event_type, bi.bin, greatest(count(b.bin) / max(t.n), 1e-6) AS base FROM rt t CROSS JOIN bi LEFT JOIN b ON b.is_ref AND b.event_type = t.event_type AND b.bin = bi.bin GROUP BY 1, 2),
wt AS (SELECT d, event_type, count(*) AS n FROM b WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2),
ws AS (SELECT t.d, t.event_type, bi.bin, max(t.n) AS n, greatest(count(b.bin) / max(t.n), 1e-6) AS share FROM wt t CROSS JOIN bi LEFT JOIN b ON b.d = t.d AND b.event_type = t.event_type AND b.bin = bi.bin GROUP BY 1, 2, 3)
SELECT ws.d AS window_start, ws.d + INTERVAL 1 DAY AS window_end, ws.event_type, max(n)::BIGINT AS rows, round(sum((share - base) * ln(share / base)), 8) AS psi,
       CASE WHEN sum((share - base) * ln(share / base)) <= 0.1 THEN 'stable' WHEN sum((share - base) * ln(share / base)) <= 0.25 THEN 'monitor' ELSE 'drift' END AS drift_label
FROM ws JOIN rs USING (event_type, bin) GROUP BY 1, 2, 3
"""
