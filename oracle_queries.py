"""Independent DuckDB SQL for every SQL-checkable query in ``__spark_entry__``.

Written directly in SQL (window functions, CTEs) — not generated from the
Spark plans — so the comparison is a real second implementation.
"""

from __future__ import annotations

# cohort + stratified split (portable md5 / row_number formulation)
BASE = """
li AS (
  SELECT l_orderkey, l_linenumber, MIN(l_partkey) AS pk, MIN(l_suppkey) AS sk,
         MIN(l_quantity) AS qty, MIN(l_extendedprice) AS price,
         MIN(l_discount) AS disc, MIN(l_tax) AS tax
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
h AS (SELECT *, l_orderkey*8 + l_linenumber AS row_id,
             md5(concat('42:y:', CAST(l_orderkey*8 + l_linenumber AS VARCHAR))) AS hy FROM li),
u AS (SELECT *, ((instr('0123456789abcdef', substr(hy,1,1))-1)*4096
               + (instr('0123456789abcdef', substr(hy,2,1))-1)*256
               + (instr('0123456789abcdef', substr(hy,3,1))-1)*16
               + (instr('0123456789abcdef', substr(hy,4,1))-1)) / CAST(65536 AS DOUBLE) AS u01 FROM h),
cohort AS (
  SELECT row_id,
    CAST(l_linenumber-1 AS DOUBLE) AS Pregnancies,
    CASE WHEN disc=0 THEN CAST(0 AS DOUBLE) ELSE 50+3*qty END AS Glucose,
    CASE WHEN tax=0 THEN CAST(0 AS DOUBLE) ELSE CAST(45+sk%60 AS DOUBLE) END AS BloodPressure,
    CASE WHEN pk%3=0 THEN CAST(0 AS DOUBLE) ELSE CAST(7+pk%50 AS DOUBLE) END AS SkinThickness,
    CASE WHEN pk%2=0 THEN CAST(0 AS DOUBLE) ELSE CAST(15+(pk*7)%600 AS DOUBLE) END AS Insulin,
    CASE WHEN l_orderkey%80=0 THEN CAST(0 AS DOUBLE) ELSE 18+price/CAST(2500 AS DOUBLE) END AS BMI,
    CAST(78+(sk*13)%1500 AS DOUBLE)/CAST(1000 AS DOUBLE) AS DiabetesPedigreeFunction,
    CAST(21+l_orderkey%60 AS DOUBLE) AS Age,
    CASE WHEN u01 < 1/(1+exp(-(-5.2+0.07*qty+0.03*(l_orderkey%60)+price/CAST(50000 AS DOUBLE))))
         THEN 1 ELSE 0 END AS Outcome
  FROM u),
spl AS (
  SELECT * EXCLUDE (rn, n, hs), CASE WHEN rn<=floor(n*0.7) THEN 'train'
                 WHEN rn<=floor(n*0.85) THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY Outcome ORDER BY hs, row_id) AS rn,
               count(*) OVER (PARTITION BY Outcome) AS n
        FROM (SELECT *, md5(concat('42:split:', CAST(row_id AS VARCHAR))) AS hs FROM cohort) a) b)
"""


def with_base(body: str, *ctes: str) -> str:
    extra = "".join(f",\n{c}" for c in ctes)
    return f"WITH {BASE}{extra}\n{body}"


SQL: dict[str, str] = {}

SQL["scan_parquet"] = with_base(
    "SELECT row_id, Pregnancies, Glucose, BloodPressure, SkinThickness, Insulin, "
    "round(BMI, 9) AS BMI, DiabetesPedigreeFunction, Age, Outcome FROM cohort"
)

SQL["split_stratified"] = with_base("SELECT row_id, Outcome, split FROM spl")

RAW = ["Pregnancies", "Glucose", "BloodPressure", "SkinThickness", "Insulin", "BMI", "DiabetesPedigreeFunction", "Age"]
ZM = ["Glucose", "BloodPressure", "SkinThickness", "Insulin", "BMI"]
DERIVED = ["glucose_bmi_interaction", "glucose_insulin_interaction", "glucose_pregnancies_interaction"]
CATS = ["age_category", "bmi_category", "glucose_category", "age_bmi_category", "age_glucose_category", "insulin_category"]
ORDERS = {
    "age_category": ["mature", "senior"],
    "bmi_category": ["underweight", "healthy", "overweight", "obese"],
    "glucose_category": ["normal", "prediabetes", "diabetes"],
    "age_bmi_category": ["underweight_mature", "underweight_senior", "healthy_mature", "healthy_senior",
                         "overweight_mature", "overweight_senior", "obese_mature", "obese_senior"],
    "age_glucose_category": ["low_mature", "low_senior", "normal_mature", "normal_senior", "hidden_mature",
                             "hidden_senior", "high_mature", "high_senior"],
    "insulin_category": ["normal", "abnormal"],
}


def _feat_select(src: str) -> str:
    bmi = ("CASE WHEN BMI IS NULL OR BMI < 0 THEN 'nan' WHEN BMI <= 18.5 THEN 'underweight' WHEN BMI <= 24.9 "
           "THEN 'healthy' WHEN BMI <= 29.9 THEN 'overweight' WHEN BMI <= CAST('inf' AS DOUBLE) THEN 'obese' ELSE 'nan' END")
    glu = ("CASE WHEN Glucose IS NULL OR Glucose < 0 THEN 'nan' WHEN Glucose <= 140 THEN 'normal' WHEN Glucose <= 200 "
           "THEN 'prediabetes' WHEN Glucose <= 300 THEN 'diabetes' ELSE 'nan' END")
    age = "CASE WHEN Age >= 50 THEN 'senior' ELSE 'mature' END"
    band = ("CASE WHEN Glucose < 70 THEN 'low' WHEN Glucose >= 70 AND Glucose < 100 THEN 'normal' "
            "WHEN Glucose >= 100 AND Glucose <= 125 THEN 'hidden' ELSE 'high' END")
    return (f"SELECT *, Glucose*BMI/CAST(1000 AS DOUBLE) AS glucose_bmi_interaction, Glucose*Insulin AS glucose_insulin_interaction, "
            f"Glucose*Pregnancies AS glucose_pregnancies_interaction, {age} AS age_category, {bmi} AS bmi_category, "
            f"{glu} AS glucose_category, ({bmi}) || '_' || ({age}) AS age_bmi_category, ({band}) || '_' || ({age}) AS age_glucose_category, "
            f"CASE WHEN Insulin BETWEEN 16 AND 166 THEN 'normal' ELSE 'abnormal' END AS insulin_category FROM {src}")


PREP = [
    "zm AS (SELECT * REPLACE (" + ", ".join(f"NULLIF({c}, 0) AS {c}" for c in ZM) + ") FROM spl)",
    "med AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in ZM) + " FROM zm WHERE split = 'train')",
    "imp AS (SELECT zm.* REPLACE (" + ", ".join(f"COALESCE({c}, m_{c}) AS {c}" for c in ZM) + ") FROM zm CROSS JOIN med)",
    "capq AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.05) AS lo_{c}, quantile_cont({c}, 0.95) AS hi_{c}" for c in RAW)
    + " FROM imp WHERE split = 'train')",
    "caps AS (SELECT " + ", ".join(f"lo_{c} - 1.5*(hi_{c}-lo_{c}) AS l_{c}, hi_{c} + 1.5*(hi_{c}-lo_{c}) AS u_{c}" for c in RAW)
    + " FROM capq)",
    "capped AS (SELECT imp.* REPLACE (" + ", ".join(
        f"CASE WHEN {c} IS NULL THEN NULL ELSE LEAST(GREATEST({c}, l_{c}), u_{c}) END AS {c}" for c in RAW)
    + ") FROM imp CROSS JOIN caps)",
    "feat AS (" + _feat_select("capped") + ")",
]
FRAW = ["fr0 AS (SELECT * REPLACE (" + ", ".join(f"NULLIF({c}, 0) AS {c}" for c in ZM) + ") FROM cohort)",
        "fr AS (" + _feat_select("fr0") + ")"]


def _sig(intercept, pairs):
    z = f"{intercept}" + "".join(f" + {w}*{f}" for f, w in pairs)
    return f"round(1/(1+exp(-({z}))), 9)"


MODELS = [
    ("fixed_logistic", -5.2, [("Glucose", 0.02), ("BMI", 0.03), ("Age", 0.01)]),
    ("glucose_age", -4.6, [("Glucose", 0.025), ("Age", 0.012)]),
    ("bmi_age_preg", -3.9, [("BMI", 0.05), ("Age", 0.02), ("Pregnancies", 0.05)]),
]
SC_ALL = "sc AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS model_name, split, row_id, Outcome AS y, {_sig(i, w)} AS p FROM spl" for n, i, w in MODELS) + ")"
SC_FIXED = "sc AS (" + f"SELECT 'fixed_logistic' AS model_name, split, row_id, Outcome AS y, {_sig(*MODELS[0][1:])} AS p FROM spl" + ")"


def sd(a, b):
    return f"(CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE)/({b}) END)"


def thr_metrics_from_counts(src: str, keys: str, fnc="1.0", fpc="1.0", extra="") -> str:
    """SELECT of rates from a relation with tn, fp, fn, tp, n, sum_p."""
    r = lambda e: f"round({e}, 9)"
    prec, rec = sd("tp", "tp+fp"), sd("tp", "tp+fn")
    return (
        f"SELECT {keys}, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp, "
        f"{r(sd('tp+tn', 'n'))} AS accuracy, {r(prec)} AS precision, {r(rec)} AS recall, "
        f"{r(sd('tn', 'tn+fp'))} AS specificity, "
        f"{r(f'CASE WHEN {prec}+{rec} = 0 THEN 0.0 ELSE 2*{prec}*{rec}/({prec}+{rec}) END')} AS f1, "
        f"{r(sd('fp', 'fp+tn'))} AS false_positive_rate, {r(sd('fn', 'fn+tp'))} AS false_negative_rate, "
        f"{r(sd('tp+fp', 'n'))} AS positive_prediction_rate, {r(sd('tp+fn', 'n'))} AS positive_prevalence, "
        f"{r(sd('tn', 'n'))} AS tn_share, {r(sd('fp', 'n'))} AS fp_share, {r(sd('fn', 'n'))} AS fn_share, "
        f"{r(sd('tp', 'n'))} AS tp_share, {r(sd('sum_p', 'n'))} AS mean_risk_score, "
        f"{r(f'fn*{fnc} + fp*{fpc}')} AS expected_cost, {r(sd(f'fn*{fnc} + fp*{fpc}', 'n'))} AS expected_cost_per_sample{extra} "
        f"FROM {src}"
    )


def counts_at(t: str, src="sc", keys="model_name, split") -> str:
    return (f"SELECT {keys}, sum(CASE WHEN p >= {t} AND y = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS fp, "
            f"sum(CASE WHEN p >= {t} AND y = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS tp, "
            f"sum(CASE WHEN p < {t} AND y = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS tn, "
            f"sum(CASE WHEN p < {t} AND y = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS fn, sum(p) AS sum_p, count(*)*1.0::DOUBLE AS n "
            f"FROM {src} GROUP BY {keys}")


CELLS = ("cells AS (SELECT model_name, split, y, round(LEAST(GREATEST(p, 1e-6), 1-1e-6), 9) AS p, count(*)*1.0 AS w "
         "FROM sc GROUP BY ALL)")
AUC = ("auc AS (SELECT model_name, split, round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN "
       "sum(pos*(cneg + 0.5*neg))/(sum(pos)*sum(neg)) END, 9) AS roc_auc FROM ("
       "SELECT *, COALESCE(sum(neg) OVER (PARTITION BY model_name, split ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cneg "
       "FROM (SELECT model_name, split, p, sum(CASE WHEN y=1 THEN w ELSE 0 END) AS pos, sum(CASE WHEN y=0 THEN w ELSE 0 END) AS neg "
       "FROM cells GROUP BY ALL) a) b GROUP BY model_name, split)")
BRIER = ("bl AS (SELECT model_name, split, round(sum(w*(p-y)*(p-y))/sum(w), 9) AS brier, "
         "round(sum(w*-(y*ln(p)+(1-y)*ln(1-p)))/sum(w), 9) AS log_loss FROM cells GROUP BY model_name, split)")


def calib_ctes(keys="model_name, split", src="cells", iters=8, prefix="") -> list[str]:
    cb, it, cal = f"{prefix}cb", f"{prefix}it", f"{prefix}cal"
    ctes = [f"{cb} AS (SELECT {keys}, ln(p/(1-p)) AS x, sum(CASE WHEN y=1 THEN w ELSE 0 END) AS pos, sum(w) AS n FROM {src} GROUP BY ALL)",
            f"{it}0 AS (SELECT {keys}, 0.0::DOUBLE AS a, 1.0::DOUBLE AS b, (sum(pos) > 0 AND sum(pos) < sum(n)) AS ok FROM {cb} GROUP BY {keys})"]
    kj = " AND ".join(f"q1.{k.strip()} = q2.{k.strip()}" for k in keys.split(","))
    for i in range(1, iters + 1):
        q = f"SELECT q1.*, q2.a, q2.b, q2.ok, 1/(1+exp(-(q2.a + q2.b*q1.x))) AS s FROM {cb} q1 JOIN {it}{i-1} q2 ON {kj}"
        g = (f"SELECT {keys}, a, b, ok, sum(pos - n*s) AS g0, sum((pos - n*s)*x) - b/1e6 AS g1, sum(n*s*(1-s)) AS h00, "
             f"sum(n*s*(1-s)*x) AS h01, sum(n*s*(1-s)*x*x) + 1e-6 AS h11 FROM ({q}) q GROUP BY {keys}, a, b, ok")
        ctes.append(
            f"{it}{i} AS (SELECT {keys}, CASE WHEN ok THEN a + COALESCE((h11*g0 - h01*g1)/NULLIF(h00*h11 - h01*h01, 0), 0) ELSE 0.0 END AS a, "
            f"CASE WHEN ok THEN b + COALESCE((h00*g1 - h01*g0)/NULLIF(h00*h11 - h01*h01, 0), 0) ELSE 1.0 END AS b, ok FROM ({g}) gg)"
        )
    ctes.append(f"{cal} AS (SELECT {keys}, round(b, 7) AS calibration_slope, round(a, 7) AS calibration_intercept, "
                f"round(abs(b-1), 7) AS calibration_slope_error, round(abs(a), 7) AS calibration_intercept_abs FROM {it}{iters})")
    return ctes


GRID = [round(0.1 + i * 0.05, 10) for i in range(17)]
GRID_SQL = "[" + ", ".join(repr(t) for t in GRID) + "]::DOUBLE[]"

_RANDOM = ("rnd AS (SELECT row_id, CASE WHEN u < 0.7::DOUBLE THEN 'train' WHEN u < (0.7::DOUBLE + 0.15::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM ("
           "SELECT row_id, ('0x' || substr(md5(concat('42:random_split:', CAST(row_id AS VARCHAR))), 1, 12))::BIGINT / 281474976710656.0 AS u FROM cohort))")
SQL["split_random"] = with_base("SELECT row_id, split FROM rnd", _RANDOM)
SQL["split_fallback"] = with_base("SELECT split, count(*) AS rows, 'random' AS strategy_resolved, 'stratify column ''Stratum'' not found' AS reason FROM rnd GROUP BY split", _RANDOM)
SQL["holdout_inner"] = with_base(
    "SELECT row_id, fold_id, CASE WHEN row_number() OVER w <= count(*) OVER (PARTITION BY fold_id, Outcome) - ceil(count(*) OVER (PARTITION BY fold_id, Outcome) * 0.25::DOUBLE) "
    "THEN 'train' ELSE 'valid' END AS inner_split FROM (SELECT row_id, Outcome, CAST((row_number() OVER (PARTITION BY Outcome ORDER BY "
    "md5(concat('42:fold:', CAST(row_id AS VARCHAR))), row_id) - 1) % 4 + 1 AS INTEGER) AS fold_id FROM spl WHERE split = 'train') "
    "WINDOW w AS (PARTITION BY fold_id, Outcome ORDER BY md5(concat('42:inner:', CAST(fold_id AS VARCHAR), ':', CAST(row_id AS VARCHAR))), row_id)")
SQL["split_report"] = with_base(
    "SELECT d.split_order, d.split, round(d.r, 6) AS requested_ratio, round(COALESCE(c.rows, 0) / CAST(sum(COALESCE(c.rows, 0)) OVER () AS DOUBLE), 6) AS observed_ratio, "
    "CAST(COALESCE(c.rows, 0) AS BIGINT) AS rows, 'stratified_random' AS strategy_requested, 'stratified_random' AS strategy_resolved, "
    "false AS fallback, CAST(NULL AS VARCHAR) AS fallback_reason FROM "
    "(VALUES (1, 'train', 0.7::DOUBLE), (2, 'validation', 0.15::DOUBLE), (3, 'test', 0.15::DOUBLE)) d(split_order, split, r) "
    "LEFT JOIN (SELECT split, count(*) AS rows FROM spl GROUP BY split) c ON c.split = d.split"
)
SQL["kfold_stratified"] = with_base(
    "SELECT row_id, Outcome, CAST((row_number() OVER (PARTITION BY Outcome ORDER BY md5(concat('42:fold:', CAST(row_id AS VARCHAR))), row_id) - 1) % 4 + 1 AS INTEGER) AS fold_id "
    "FROM spl WHERE split IN ('train', 'validation')"
)
SQL["sample_n"] = with_base(
    "SELECT row_id, Glucose, Outcome FROM spl WHERE split = 'validation' ORDER BY md5(concat('42:sample:', CAST(row_id AS VARCHAR))), row_id LIMIT 128"
)
SQL["select_roles"] = with_base("SELECT row_id, Outcome, " + ", ".join(f"round({c}, 9) AS {c}" if c == "BMI" else c for c in RAW) + " FROM cohort")
SQL["clean_coerce"] = with_base(
    "SELECT * FROM (SELECT " + ", ".join(
        f"CAST(sum(CASE WHEN TRY_CAST({'CASE WHEN Glucose = 0 THEN $$$$ ELSE CAST(Glucose AS VARCHAR) END' if c == 'Glucose' else f'CAST({c} AS VARCHAR)'} AS DOUBLE) IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS {c}"
        for c in RAW) + " FROM cohort) UNPIVOT (replaced FOR feature IN (" + ", ".join(RAW) + "))"
).replace("$$$$", "''")
SQL["zero_as_missing"] = with_base("SELECT row_id, " + ", ".join(f"round(NULLIF({c}, 0), 9) AS {c}" if c == "BMI" else f"NULLIF({c}, 0) AS {c}" for c in ZM) + " FROM cohort")
SQL["feature_build"] = with_base("SELECT row_id, " + ", ".join(f"round({c}, 9) AS {c}" for c in DERIVED) + ", " + ", ".join(CATS) + " FROM fr", *FRAW)
SQL["interactions"] = with_base("SELECT " + ", ".join(f"round(sum({c}), 9) AS sum_{c}" for c in DERIVED) + ", "
                                + ", ".join(f"count({c}) AS n_{c}" for c in DERIVED) + " FROM fr", *FRAW)
SQL["bin_cut"] = with_base("SELECT bmi_category, glucose_category, count(*) AS n FROM fr GROUP BY ALL", *FRAW)
for _k, _c in [("threshold_category", "age_category"), ("cross_category", "age_bmi_category"),
               ("cascade_band", "age_glucose_category"), ("range_flag", "insulin_category")]:
    SQL[_k] = with_base(f"SELECT {_c} AS category, count(*) AS n FROM fr GROUP BY ALL", *FRAW)
SQL["impute_stat"] = with_base("SELECT row_id, split, " + ", ".join(f"round({c}, 9) AS {c}" for c in ZM) + " FROM imp", *PREP[:3])
SQL["fit_robust_scale"] = with_base(
    "SELECT feature, round(q[2], 9) AS median, round(CASE WHEN q[3]-q[1] = 0 THEN 1.0 ELSE q[3]-q[1] END, 9) AS iqr FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, quantile_cont({c}, [0.25, 0.5, 0.75]) AS q FROM zm WHERE split = 'train'" for c in ZM)
    + ")", PREP[0])
SQL["fit_caps"] = with_base(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(l_{c}, 9) AS lower, round(u_{c}, 9) AS upper FROM caps" for c in RAW), *PREP[:5])
SQL["clip_caps"] = with_base("SELECT row_id, " + ", ".join(f"round({c}, 9) AS {c}" for c in RAW) + " FROM capped", *PREP[:6])
SQL["split_filter"] = with_base("SELECT split, count(*) AS n, round(avg(Glucose), 9) AS avg_glucose FROM spl WHERE split IN ('train','validation') GROUP BY split")
SQL["fit_onehot"] = with_base(
    "SELECT feature, CAST(row_number() OVER (PARTITION BY feature ORDER BY category) AS INTEGER) AS position, category FROM ("
    + " UNION ".join(f"SELECT DISTINCT '{c}' AS feature, COALESCE({c}, 'nan') AS category FROM feat WHERE split = 'train'" for c in CATS) + ")",
    *PREP)
SQL["transform_onehot"] = with_base(
    "SELECT split, " + ", ".join(f"sum(CASE WHEN COALESCE({c}, 'nan') = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS {c}_{v}"
                                 for c in CATS for v in ORDERS[c][1:]) + " FROM feat GROUP BY split", *PREP)
NUM11 = RAW + DERIVED
SQL["fit_standard"] = with_base(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(CASE WHEN stddev_pop({c}) = 0 OR stddev_pop({c}) IS NULL THEN 1.0 ELSE stddev_pop({c}) END, 6) AS scale "
    f"FROM feat WHERE split = 'train'" for c in NUM11), *PREP)
SQL["transform_standard"] = with_base(
    "SELECT split, " + ", ".join(f"round(avg(({c} - m_{c}) / s_{c}), 6) + 0.0 AS {c}" for c in RAW) + " FROM feat CROSS JOIN ("
    "SELECT " + ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS s_{c}" for c in RAW)
    + " FROM feat WHERE split = 'train') GROUP BY split", *PREP)
SQL["fit_label_encoder"] = with_base("SELECT Outcome AS label, CAST(dense_rank() OVER (ORDER BY Outcome) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT Outcome FROM spl WHERE split = 'train')")
SQL["class_weights"] = with_base("SELECT label, n_class, round(sum(n_class) OVER () / (count(*) OVER () * n_class), 9) AS weight FROM "
                                 "(SELECT Outcome AS label, count(*) AS n_class FROM spl WHERE split = 'train' GROUP BY Outcome)")
SQL["clip_probability"] = with_base("SELECT row_id, round(LEAST(GREATEST(p*1.5 - 0.25, 1e-6), 1 - 1e-6), 9) AS p_clipped FROM sc", SC_FIXED)
SQL["decide"] = with_base("SELECT CAST(p >= 0.5 AS INTEGER) AS decision, count(*) AS n FROM sc GROUP BY ALL", SC_FIXED)
BAND_SQL = ("CASE WHEN p >= 0.0 AND p < 0.3 THEN 'Baixo risco' WHEN p >= 0.3 AND p < 0.55 THEN 'Risco moderado' "
            "WHEN p >= 0.55 AND p < 0.75 THEN 'Alto risco' WHEN p >= 0.75 AND p < 1.01 THEN 'Risco critico' ELSE {d} END")
ACTION_SQL = ("CASE lower(trim(COALESCE({b}, ''))) WHEN 'risco critico' THEN 'Encaminhar avaliação clínica imediata' "
              "WHEN 'alto risco' THEN 'Priorizar revisão clínica' WHEN 'risco moderado' THEN 'Solicitar triagem complementar' "
              "WHEN 'baixo risco' THEN 'Manter monitoramento de rotina' ELSE 'Revisar contexto clínico' END")
SQL["risk_band"] = with_base("SELECT model_name, " + BAND_SQL.format(d="'Sem faixa'") + " AS risk_band, count(*) AS n FROM sc GROUP BY ALL", SC_ALL)
SQL["recommended_action"] = with_base("SELECT " + ACTION_SQL.format(b="(" + BAND_SQL.format(d="NULL") + ")") + " AS action, count(*) AS n FROM sc GROUP BY ALL", SC_FIXED)
SQL["safe_divide"] = with_base("SELECT row_id, round(CASE WHEN Insulin = 0 THEN 0.0 ELSE Glucose/Insulin END, 9) AS ratio FROM cohort")
SQL["relative_delta_pct"] = with_base(
    "SELECT m.split, " + ", ".join(
        f"round(CASE WHEN abs(r.{c}) < 1e-8 THEN (CASE WHEN abs(m.{c}) < 1e-8 THEN 0.0 ELSE 100.0 END) ELSE abs((m.{c} - r.{c})/r.{c})*100 END, 6) AS {c}"
        for c in RAW) + " FROM (SELECT split, " + ", ".join(f"avg({c}) AS {c}" for c in RAW) + " FROM spl GROUP BY split) m, "
    "(SELECT " + ", ".join(f"avg({c}) AS {c}" for c in RAW) + " FROM spl WHERE split = 'train') r WHERE m.split <> 'train'")
SQL["confusion_counts"] = with_base("SELECT model_name, split, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp FROM c",
                                    SC_ALL, "c AS (" + counts_at("0.5") + ")")
SQL["threshold_metrics"] = with_base(
    "SELECT * EXCLUDE (expected_cost, expected_cost_per_sample), 0.5::DOUBLE AS threshold FROM (" + thr_metrics_from_counts("c", "model_name, split") + ")",
    SC_ALL, "c AS (" + counts_at("0.5") + ")")
SQL["expected_cost"] = with_base("SELECT model_name, split, expected_cost, expected_cost_per_sample FROM (" + thr_metrics_from_counts("c", "model_name, split", "8.0", "1.0") + ")",
                                 SC_ALL, "c AS (" + counts_at("0.3") + ")")
SQL["roc_auc"] = with_base("SELECT * FROM auc", SC_ALL, CELLS, AUC)
SQL["brier_log_loss"] = with_base("SELECT * FROM bl", SC_ALL, CELLS, BRIER)
SQL["calibration_fit"] = with_base("SELECT * FROM cal", SC_ALL, CELLS, *calib_ctes())
SQL["evaluate_all_splits"] = with_base(
    "SELECT t.*, auc.roc_auc, bl.brier, bl.log_loss, cal.calibration_slope, cal.calibration_intercept, cal.calibration_slope_error, cal.calibration_intercept_abs "
    "FROM (SELECT *, 0.5::DOUBLE AS threshold FROM (" + thr_metrics_from_counts("c", "model_name, split") + ")) t "
    "JOIN auc USING (model_name, split) JOIN bl USING (model_name, split) JOIN cal USING (model_name, split)",
    SC_ALL, "c AS (" + counts_at("0.5") + ")", CELLS, AUC, BRIER, *calib_ctes())
_EVAL_COLS = ["tn", "fp", "fn", "tp", "accuracy", "precision", "recall", "specificity", "f1", "false_positive_rate", "false_negative_rate", "positive_prediction_rate",
              "positive_prevalence", "tn_share", "fp_share", "fn_share", "tp_share", "mean_risk_score", "expected_cost", "expected_cost_per_sample", "roc_auc", "brier", "log_loss",
              "calibration_slope", "calibration_intercept", "calibration_slope_error", "calibration_intercept_abs", "r2", "mape", "n_samples"]
SQL["evaluate"] = with_base(
    "SELECT d.model_name, d.split, 0.5::DOUBLE AS threshold, " + ", ".join(f"COALESCE(e.{c}, 0) AS {c}" for c in _EVAL_COLS)
    + " FROM (SELECT DISTINCT model_name, unnest(['train', 'validation', 'test', 'holdout']) AS split FROM sc) d LEFT JOIN ("
    "SELECT t.*, auc.roc_auc, bl.brier, bl.log_loss, cal.calibration_slope, cal.calibration_intercept, cal.calibration_slope_error, cal.calibration_intercept_abs, q.r2, q.mape, "
    "CAST(t.tn + t.fp + t.fn + t.tp AS BIGINT) AS n_samples FROM (" + thr_metrics_from_counts("c", "model_name, split") + ") t "
    "JOIN auc USING (model_name, split) JOIN bl USING (model_name, split) JOIN cal USING (model_name, split) JOIN q USING (model_name, split)) e USING (model_name, split)",
    SC_ALL, "c AS (" + counts_at("0.5") + ")", CELLS, AUC, BRIER, *calib_ctes(),
    "q AS (SELECT model_name, split, round(1 - sum((y - p) * (y - p)) / sum((y - m) * (y - m)), 9) AS r2, round(avg(abs(y - p)) / greatest(avg(y), 1e-8) * 100, 6) AS mape "
    "FROM (SELECT *, avg(y) OVER (PARTITION BY model_name, split) AS m FROM sc) z GROUP BY ALL)")
SQL["threshold_grid"] = with_base(
    f"SELECT CAST(i AS INTEGER) AS threshold_index, t AS threshold, (t >= pmin AND t <= pmax) AS within_range FROM "
    f"(SELECT unnest(range(1, 18)) AS i, unnest({GRID_SQL}) AS t) g, (SELECT min(p) AS pmin, max(p) AS pmax FROM sc WHERE split = 'validation') s",
    SC_FIXED)
SWEEP = ("sw AS (SELECT model_name, split, t AS threshold, sum(CASE WHEN p >= t AND y = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS fp, "
         "sum(CASE WHEN p >= t AND y = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS tp, sum(CASE WHEN p < t AND y = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS tn, "
         "sum(CASE WHEN p < t AND y = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS fn, sum(p) AS sum_p, count(*)*1.0::DOUBLE AS n "
         f"FROM sc, (SELECT unnest({GRID_SQL}) AS t) g GROUP BY model_name, split, t)")
SQL["threshold_sweep"] = with_base(thr_metrics_from_counts("sw", "model_name, split, threshold"), SC_ALL, SWEEP)

POLICY_COLS = ("model_name, policy_name, policy_label, strategy, threshold, constraint_satisfied, tn, fp, fn, tp, accuracy, precision, recall, "
               "specificity, f1, false_positive_rate, false_negative_rate, positive_prediction_rate, positive_prevalence, tn_share, fp_share, "
               "fn_share, tp_share, mean_risk_score, expected_cost, expected_cost_per_sample")


def policy_sql(where: str = "split = 'validation'", keys: str = "model_name") -> list[str]:
    """CTEs: scv (filtered scores), pol (chosen policy rows) — costed policies by brute force over the grid."""
    fixed = thr_metrics_from_counts(f"({counts_at('0.5', 'scv', keys)})", keys,
                                    extra=", 'default_050' AS policy_name, 'Threshold 0.50' AS policy_label, 'fixed_threshold' AS strategy, 0.5::DOUBLE AS threshold, true AS constraint_satisfied")
    costed = []
    for name, label, fnc, fpc, mr, mp in [("prioritize_recall", "Priorizar recall", "8.0", "1.0", 0.85, 0.0),
                                          ("prioritize_precision", "Priorizar precision", "1.0", "6.0", 0.0, 0.75)]:
        sw = (f"SELECT {keys}, t AS threshold, sum(CASE WHEN p >= t AND y = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS fp, "
              "sum(CASE WHEN p >= t AND y = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS tp, sum(CASE WHEN p < t AND y = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS tn, "
              "sum(CASE WHEN p < t AND y = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS fn, sum(p) AS sum_p, count(*)*1.0::DOUBLE AS n "
              f"FROM scv, (SELECT unnest({GRID_SQL}) AS t) g GROUP BY {keys}, t")
        m = thr_metrics_from_counts(f"({sw})", f"{keys}, threshold", fnc, fpc)
        costed.append(
            f"SELECT * EXCLUDE (rk) FROM (SELECT *, '{name}' AS policy_name, '{label}' AS policy_label, 'min_expected_cost' AS strategy, "
            f"(recall >= {mr} AND precision >= {mp} AND specificity >= 0.0) AS constraint_satisfied, "
            f"row_number() OVER (PARTITION BY {keys} ORDER BY (recall >= {mr} AND precision >= {mp} AND specificity >= 0.0) DESC, "
            f"expected_cost, false_negative_rate, recall DESC, threshold) AS rk FROM ({m})) WHERE rk = 1")
    cols = POLICY_COLS.replace("model_name", keys)
    union = " UNION ALL ".join(f"SELECT {cols} FROM ({q})" for q in [fixed, *costed])
    return [f"scv AS (SELECT * FROM sc WHERE {where})", f"pol AS ({union})"]


SQL["policy_select"] = with_base("SELECT * FROM pol", SC_ALL, *policy_sql())

# ------------------------------------------------------------ quality / drift
_CHECK = RAW + ["Outcome"]
_RANGES = {"Pregnancies": (0, 20), "Glucose": (0, 300), "BloodPressure": (0, 200), "SkinThickness": (0, 100),
           "Insulin": (0, 900), "BMI": (0, 80), "DiabetesPedigreeFunction": (0, 3), "Age": (0, 120)}
CLEANED = "cl AS (SELECT row_id, Outcome, " + ", ".join(f"COALESCE(CASE WHEN isnan(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE)) THEN NULL ELSE TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) END, 0.0) AS {c}" for c in RAW) + " FROM cohort)"
_vc_agg = ("va AS (SELECT count(*) AS n_rows, " + ", ".join(f"sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS nn_{c}" for c in _CHECK) + ", "
           + ", ".join(f"sum(CASE WHEN {c} IS NOT NULL AND NOT ({c} BETWEEN {lo} AND {hi}) THEN 1 ELSE 0 END) AS bt_{c}" for c, (lo, hi) in _RANGES.items())
           + ", sum(CASE WHEN Outcome IS NOT NULL AND Outcome NOT IN (0, 1) THEN 1 ELSE 0 END) AS ds FROM cl)")
_vc_rows = ([f"SELECT 'expect_column_exists' AS expectation, '{c}' AS column_name, 'critical' AS severity, CAST(0 AS BIGINT) AS unexpected_count, true AS success FROM va" for c in _CHECK]
            + [f"SELECT 'expect_not_null', '{c}', 'critical', CAST(nn_{c} AS BIGINT), nn_{c} = 0 FROM va" for c in _CHECK]
            + [f"SELECT 'expect_between', '{c}', 'warning', CAST(bt_{c} AS BIGINT), bt_{c} = 0 FROM va" for c in _RANGES]
            + ["SELECT 'expect_row_count', '*', 'critical', CAST(n_rows AS BIGINT), n_rows >= 20 FROM va",
               "SELECT 'expect_distinct_in_set', 'Outcome', 'critical', CAST(ds AS BIGINT), ds = 0 FROM va"])
SQL["validate_clean"] = with_base(" UNION ALL ".join(_vc_rows), CLEANED, _vc_agg)
_BAD = "sum(CASE WHEN split IS NULL OR split NOT IN ('train','validation','test') THEN 1 ELSE 0 END) AS bad"
SQL["validate_split"] = with_base(
    "SELECT 'all' AS scope, 'expect_column_exists' AS expectation, 'critical' AS severity, CAST(0 AS BIGINT) AS observed, true AS success UNION ALL "
    "SELECT scope, e.expectation, e.severity, e.observed, e.success FROM (SELECT scope, rows, bad FROM ("
    "SELECT d.scope, COALESCE(c.rows, 0) AS rows, COALESCE(c.bad, 0) AS bad FROM (VALUES ('train'), ('validation'), ('test')) d(scope) "
    f"LEFT JOIN (SELECT split AS scope, count(*) AS rows, {_BAD} FROM mk GROUP BY split) c USING (scope) "
    f"UNION ALL SELECT 'all', count(*), {_BAD} FROM mk)) t, "
    "LATERAL (SELECT 'expect_values_in_set' AS expectation, 'critical' AS severity, CAST(bad AS BIGINT) AS observed, bad = 0 AS success "
    "UNION ALL SELECT 'expect_row_count_min', 'critical', CAST(rows AS BIGINT), rows >= 1 "
    "UNION ALL SELECT 'expect_row_count_warn', 'warning', CAST(rows AS BIGINT), rows >= 5) e",
    "mk AS (SELECT * REPLACE (CASE WHEN row_id % 97 = 0 THEN NULL WHEN row_id % 89 = 0 THEN 'tets' ELSE split END AS split) FROM spl)")
SQL["minority_ratio"] = with_base(
    "SELECT split, round(min(share), 9) AS minority_ratio, count(*) AS n_classes, CASE WHEN min(share) < 0.05 THEN 'warning' ELSE 'ok' END AS status "
    "FROM (SELECT split, Outcome, count(*) / sum(count(*)) OVER (PARTITION BY split) AS share FROM spl GROUP BY split, Outcome) GROUP BY split")
_ct = [(c, "numerical", "double") for c in RAW]
SQL["contract_report"] = with_base(
    " UNION ALL ".join(
        [f"SELECT 'Outcome' AS column_name, 'target' AS contract_group, true AS present, 'integer' AS observed_dtype, round(avg(CASE WHEN Outcome IS NULL THEN 1.0 ELSE 0.0 END), 9) AS null_ratio, 'ok' AS contract_status FROM cl"]
        + [f"SELECT '{c}', '{g}', true, '{t}', round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 9), 'ok' FROM cl" for c, g, t in _ct]
        + ["SELECT 'row_id', 'unexpected', true, 'bigint', round(avg(CASE WHEN row_id IS NULL THEN 1.0 ELSE 0.0 END), 9), 'unexpected' FROM cl"]),
    CLEANED)
SQL["freshness_report"] = (
    "SELECT event_type, CAST(floor(epoch(max(ts))) AS BIGINT) AS latest_epoch, "
    "round((epoch(TIMESTAMP '2024-02-05 00:00:00') - floor(epoch(max(ts)))) / 3600.0, 6) AS age_hours, "
    "CASE WHEN max(ts) IS NULL THEN 'missing' WHEN (epoch(TIMESTAMP '2024-02-05 00:00:00') - floor(epoch(max(ts)))) / 3600.0 <= 168 THEN 'fresh' "
    "WHEN (epoch(TIMESTAMP '2024-02-05 00:00:00') - floor(epoch(max(ts)))) / 3600.0 <= 720 THEN 'warning' ELSE 'stale' END AS freshness_status "
    "FROM events GROUP BY event_type")
_PROBS = "[" + ", ".join(repr(i * (1.0 / 10)) for i in range(11)) + "]::DOUBLE[]"
_DRIFT = [
    "dl AS (" + " UNION ALL ".join(f"SELECT split, '{c}' AS feature_name, CAST({c} AS DOUBLE) AS v FROM feat WHERE split IN ('train','validation','test') AND {c} IS NOT NULL AND NOT isnan({c})" for c in NUM11) + ")",
    f"de AS (SELECT feature_name, list_sort(list_distinct(q[2:10])) AS edges FROM (SELECT feature_name, quantile_cont(v, {_PROBS}) AS q FROM dl WHERE split = 'train' GROUP BY feature_name))",
    "db AS (SELECT dl.split, dl.feature_name, len(list_filter(de.edges, lambda e: e <= dl.v)) AS bin FROM dl JOIN de USING (feature_name))",
    "dg AS (SELECT s.split, de.feature_name, b.bin FROM (VALUES ('train'), ('validation'), ('test')) s(split), de, LATERAL (SELECT unnest(range(0, len(de.edges) + 1)) AS bin) b)",
    "dc AS (SELECT dg.split, dg.feature_name, dg.bin, COALESCE(c.n, 0) AS n FROM dg LEFT JOIN (SELECT split, feature_name, bin, count(*) AS n FROM db GROUP BY ALL) c USING (split, feature_name, bin))",
    "dr AS (SELECT *, greatest(n / greatest(sum(n) OVER (PARTITION BY split, feature_name), 1), 1e-6) AS r FROM dc)",
    "dp AS (SELECT c.split, c.feature_name, sum((c.r - t.r) * ln(c.r / t.r)) AS psi FROM dr c JOIN dr t ON t.split = 'train' AND t.feature_name = c.feature_name AND t.bin = c.bin WHERE c.split <> 'train' GROUP BY c.split, c.feature_name)",
    "ds AS (SELECT split, feature_name, avg(v) AS m, stddev_pop(v) AS s FROM dl GROUP BY ALL)",
]
SQL["drift_psi"] = with_base(
    "SELECT 'train' AS reference_split, dp.split AS comparison_split, dp.feature_name, round(r.m, 6) AS reference_mean, round(c.m, 6) AS comparison_mean, "
    "round(r.s, 6) AS reference_std, round(c.s, 6) AS comparison_std, "
    "round(CASE WHEN abs(r.m) < 1e-8 THEN (CASE WHEN abs(c.m) < 1e-8 THEN 0.0 ELSE 100.0 END) ELSE abs((c.m - r.m)/r.m)*100 END, 6) AS mean_delta_pct, "
    "round(dp.psi, 8) AS psi, CASE WHEN dp.psi <= 0.1 THEN 'stable' WHEN dp.psi <= 0.25 THEN 'monitor' ELSE 'drift' END AS drift_label "
    "FROM dp JOIN ds c ON c.split = dp.split AND c.feature_name = dp.feature_name JOIN ds r ON r.split = 'train' AND r.feature_name = dp.feature_name",
    *PREP, *_DRIFT)

# ---------------------------------------------------------------- selection
_BOUNDED = ("'roc_auc','accuracy','precision','recall','specificity','f1','false_positive_rate','false_negative_rate','brier',"
            "'calibration_slope_error','calibration_intercept_abs','tn_share','fp_share','fn_share','tp_share','positive_prediction_rate','positive_prevalence'")
_UTIL = ("CASE WHEN raw_value IS NULL OR isnan(raw_value) THEN 0.5 "
         f"WHEN metric IN ({_BOUNDED}) THEN (CASE WHEN direction = 'maximize' THEN least(greatest(raw_value, 0.0), 1.0) ELSE 1.0 - least(greatest(raw_value, 0.0), 1.0) END) "
         "WHEN metric IN ('log_loss','expected_cost','expected_cost_per_sample','mape') THEN (CASE WHEN direction = 'minimize' THEN 1.0/(1.0+greatest(raw_value, 0.0)) ELSE 1.0 - 1.0/(1.0+greatest(raw_value, 0.0)) END) "
         "WHEN metric = 'r2' THEN (CASE WHEN direction = 'maximize' THEN least(greatest((raw_value+1.0)/2.0, 0.0), 1.0) ELSE 1.0 - least(greatest((raw_value+1.0)/2.0, 0.0), 1.0) END) "
         "WHEN metric = 'mean_risk_score' THEN (CASE WHEN direction = 'maximize' THEN least(greatest(raw_value/100.0, 0.0), 1.0) ELSE 1.0 - least(greatest(raw_value/100.0, 0.0), 1.0) END) "
         "ELSE (CASE WHEN direction = 'minimize' THEN 1.0/(1.0+abs(raw_value)) ELSE 1.0 - 1.0/(1.0+abs(raw_value)) END) END")
_COMPONENTS = [("brier", "validation", "minimize", 0.22), ("log_loss", "validation", "minimize", 0.15),
               ("calibration_slope_error", "validation", "minimize", 0.08), ("calibration_intercept_abs", "validation", "minimize", 0.05),
               ("roc_auc", "validation", "maximize", 0.05), ("recall", "policy", "maximize", 0.16),
               ("false_negative_rate", "policy", "minimize", 0.10), ("precision", "policy", "maximize", 0.04),
               ("false_positive_rate", "policy", "minimize", 0.02), ("expected_cost_per_sample", "policy", "minimize", 0.05)]
_TOTAL_W = repr(float(sum(c[3] for c in _COMPONENTS)))
_VAL = ("val AS (SELECT t.*, auc.roc_auc, bl.brier, bl.log_loss, cal.calibration_slope_error, cal.calibration_intercept_abs FROM ("
        + thr_metrics_from_counts("c", "model_name, split") + ") t JOIN auc USING (model_name, split) JOIN bl USING (model_name, split) "
        "JOIN cal USING (model_name, split) WHERE split = 'validation')")
_POLP = ("pp AS (SELECT model_name, policy_name, threshold AS policy_threshold, recall AS policy_recall, precision AS policy_precision, "
         "false_negative_rate AS policy_false_negative_rate, false_positive_rate AS policy_false_positive_rate, "
         "expected_cost_per_sample AS policy_expected_cost_per_sample FROM pol WHERE policy_name = 'prioritize_recall')")


def _comp_ctes(compat=False):
    rows = []
    for m, src, d, w in _COMPONENTS:
        val = (f"v.{m}" if src == "validation" else ("CAST(NULL AS DOUBLE)" if compat else f"p.policy_{m}"))
        rows.append(f"SELECT v.model_name, '{m}' AS metric, '{src}' AS source, '{d}' AS direction, {w}::DOUBLE AS weight, CAST({val} AS DOUBLE) AS raw_value FROM val v LEFT JOIN pp p USING (model_name)")
    return [f"cmp0 AS ({' UNION ALL '.join(rows)})",
            f"cmp AS (SELECT *, {_UTIL} AS utility FROM cmp0)",
            f"cmpm AS (SELECT model_name, sum(utility*weight)/{_TOTAL_W} AS composite_score FROM cmp GROUP BY model_name)"]


_SEL_BASE = [SC_ALL, "c AS (" + counts_at("0.5") + ")", CELLS, AUC, BRIER, *calib_ctes(), _VAL, *policy_sql(), _POLP]
SQL["composite_score"] = with_base(
    "SELECT model_name, metric, source, direction, weight, round(raw_value, 9) AS raw_value, round(utility, 9) AS utility, round(composite_score, 9) AS composite_score "
    "FROM cmp JOIN cmpm USING (model_name)", *_SEL_BASE, *_comp_ctes())
SQL["composite_score_compat"] = with_base("SELECT model_name, round(composite_score, 9) AS composite_score FROM cmpm", *_SEL_BASE, *_comp_ctes(True))
_CARD = ("card AS (SELECT v.model_name, CAST(row_number() OVER (ORDER BY m.composite_score DESC, p.policy_expected_cost_per_sample ASC NULLS LAST, v.brier, v.log_loss, "
         "v.calibration_slope_error, v.model_name) AS INTEGER) AS rank, m.composite_score, v.roc_auc, v.brier, v.log_loss, v.calibration_slope_error, "
         "p.policy_name, p.policy_threshold, p.policy_recall, p.policy_expected_cost_per_sample FROM val v LEFT JOIN pp p USING (model_name) JOIN cmpm m USING (model_name))")
SQL["scorecard"] = with_base("SELECT * REPLACE (round(composite_score, 9) AS composite_score) FROM card", *_SEL_BASE, *_comp_ctes(), _CARD)
SQL["select_best"] = with_base("SELECT model_name, policy_name, policy_threshold, round(composite_score, 9) AS composite_score FROM card WHERE rank = 1",
                               *_SEL_BASE, *_comp_ctes(), _CARD)
_TEST = ("tst AS (SELECT t.*, auc.roc_auc, bl.brier, bl.log_loss FROM (" + thr_metrics_from_counts("c", "model_name, split")
         + ") t JOIN auc USING (model_name, split) JOIN bl USING (model_name, split) WHERE split = 'test')")
SQL["model_frontier"] = with_base(
    "SELECT v.model_name, COALESCE(k.rank = 1, false) AS selected_for_refit, "
    + ", ".join(f"v.{m} AS validation_{m}" for m in ("accuracy", "precision", "recall", "f1", "roc_auc", "brier", "log_loss", "calibration_slope_error", "calibration_intercept_abs"))
    + ", CASE WHEN k.rank = 1 THEN k.policy_name END AS deployment_policy_name, CASE WHEN k.rank = 1 THEN k.policy_threshold END AS deployment_threshold, "
    "round(k.composite_score, 9) AS composite_score, k.rank FROM val v LEFT JOIN card k USING (model_name)", *_SEL_BASE, *_comp_ctes(), _CARD)
_BEST_T = "(SELECT policy_threshold FROM card WHERE rank = 1)"
SQL["split_comparison"] = with_base(
    "SELECT t.*, CAST(CASE t.split WHEN 'train' THEN 1 WHEN 'validation' THEN 2 ELSE 3 END AS INTEGER) AS split_order, "
    "CAST(t.tn + t.fp + t.fn + t.tp AS BIGINT) AS n_samples, card.policy_name, card.policy_threshold, auc.roc_auc, bl.brier, bl.log_loss, "
    "cal.calibration_slope, cal.calibration_intercept, cal.calibration_slope_error, cal.calibration_intercept_abs, "
    "round(auc.roc_auc - max(CASE WHEN t.split = 'train' THEN auc.roc_auc END) OVER (PARTITION BY t.model_name), 9) AS roc_auc_gap_vs_train, "
    "round(bl.brier - max(CASE WHEN t.split = 'train' THEN bl.brier END) OVER (PARTITION BY t.model_name), 9) AS brier_gap_vs_train "
    "FROM (" + thr_metrics_from_counts("c2", "model_name, split", "8.0", "1.0") + ") t JOIN auc USING (model_name, split) JOIN bl USING (model_name, split) "
    "JOIN cal USING (model_name, split) JOIN card USING (model_name) WHERE card.rank = 1",
    *_SEL_BASE, *_comp_ctes(), _CARD, "c2 AS (" + counts_at(_BEST_T) + ")")

# -------------------------------------------------------------- robustness
_FOLD = ("fo AS (SELECT *, CAST((row_number() OVER (PARTITION BY Outcome ORDER BY md5(concat('42:fold:', CAST(row_id AS VARCHAR))), row_id) - 1) % 4 + 1 AS INTEGER) AS fold "
         "FROM spl WHERE split IN ('train', 'validation'))")
SC_FOLD = "sc AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS model_name, CAST(fold AS VARCHAR) AS split, row_id, Outcome AS y, {_sig(i, w)} AS p FROM fo" for n, i, w in MODELS) + ")"
_FOLD_PAYLOAD = ("fm AS (SELECT t.* RENAME (split AS fold_id), auc.roc_auc, bl.brier, bl.log_loss, cal.calibration_slope, cal.calibration_intercept, "
                 "cal.calibration_slope_error, cal.calibration_intercept_abs FROM (SELECT *, 0.1::DOUBLE AS threshold FROM ("
                 + thr_metrics_from_counts("c", "model_name, split", "8.0", "1.0") + ")) t JOIN auc USING (model_name, split) "
                 "JOIN bl USING (model_name, split) JOIN cal USING (model_name, split))")
_FOLD_BASE = [_FOLD, SC_FOLD, "c AS (" + counts_at("0.1") + ")", CELLS, AUC, BRIER, *calib_ctes(), _FOLD_PAYLOAD]
SQL["cv_fold_metrics"] = with_base("SELECT * FROM fm", *_FOLD_BASE)
_CVM = ["roc_auc", "brier", "log_loss", "calibration_slope_error", "calibration_intercept_abs", "accuracy", "precision", "recall", "specificity", "f1",
        "false_positive_rate", "false_negative_rate", "positive_prediction_rate", "positive_prevalence", "tn_share", "fp_share", "fn_share", "tp_share",
        "mean_risk_score", "expected_cost", "expected_cost_per_sample", "threshold"]
SQL["cv_summary"] = with_base(
    "SELECT model_name, metric_name, count(*) AS folds, round(avg(value), 8) AS mean_value, round(stddev_pop(value), 8) AS std_value, "
    "round(CASE WHEN abs(avg(value)) <= 1e-8 THEN 0.0 ELSE abs(stddev_pop(value)/avg(value))*100 END, 6) AS variation_pct_of_mean, "
    "round(min(value), 8) AS min_value, round(max(value), 8) AS max_value, round(COALESCE(max(jump), 0.0), 8) AS max_fold_jump, "
    "CASE WHEN (CASE WHEN abs(avg(value)) <= 1e-8 THEN 0.0 ELSE abs(stddev_pop(value)/avg(value))*100 END) <= 10 THEN 'stable' "
    "WHEN (CASE WHEN abs(avg(value)) <= 1e-8 THEN 0.0 ELSE abs(stddev_pop(value)/avg(value))*100 END) <= 20 THEN 'moderate' ELSE 'volatile' END AS robustness_label "
    "FROM (SELECT *, abs(value - lag(value) OVER (PARTITION BY model_name, metric_name ORDER BY fold_id)) AS jump FROM ("
    "SELECT model_name, fold_id, metric_name, CAST(value AS DOUBLE) AS value FROM (SELECT model_name, fold_id, "
    + ", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m in _CVM) + " FROM fm) UNPIVOT (value FOR metric_name IN (" + ", ".join(_CVM) + "))"
    ") WHERE value IS NOT NULL AND NOT isnan(value)) GROUP BY model_name, metric_name", *_FOLD_BASE)

import math as _math  # noqa: E402

_PCDF = []
_acc = 0.0
for _k in range(17):
    _acc += _math.exp(-1.0) / _math.factorial(_k)
    _PCDF.append(_acc)
_POIS = "CASE " + " ".join(f"WHEN u < {c!r} THEN {k}" for k, c in enumerate(_PCDF)) + f" ELSE {len(_PCDF)} END"
_BM = ["roc_auc", "brier", "log_loss", "recall", "precision", "f1", "false_negative_rate", "false_positive_rate", "expected_cost",
       "calibration_slope_error", "calibration_intercept_abs"]


def _boot_sql(iters: int) -> str:
    scw = ("scw AS (SELECT * FROM (SELECT model_name, CAST(it AS VARCHAR) AS split, row_id, y, p, " + _POIS + " AS w FROM ("
           "SELECT s.*, it, ('0x' || substr(md5(concat('42:boot:', CAST(it AS VARCHAR), ':', CAST(row_id AS VARCHAR))), 1, 12))::BIGINT / 281474976710656.0 AS u "
           f"FROM sc s, range(1, {iters + 1}) r(it) WHERE s.split = 'validation')) WHERE w > 0)")
    cells = ("cells AS (SELECT model_name, split, y, round(LEAST(GREATEST(p, 1e-6), 1-1e-6), 9) AS p, sum(w)*1.0::DOUBLE AS w FROM scw GROUP BY ALL)")
    cnt = ("c AS (SELECT model_name, split, sum(CASE WHEN p >= 0.1 AND y = 0 THEN w ELSE 0.0 END) AS fp, sum(CASE WHEN p >= 0.1 AND y = 1 THEN w ELSE 0.0 END) AS tp, "
           "sum(CASE WHEN p < 0.1 AND y = 0 THEN w ELSE 0.0 END) AS tn, sum(CASE WHEN p < 0.1 AND y = 1 THEN w ELSE 0.0 END) AS fn, sum(w*p) AS sum_p, sum(w) AS n FROM cells GROUP BY ALL)")
    per = ("per AS (SELECT t.*, auc.roc_auc, bl.brier, bl.log_loss, cal.calibration_slope_error, cal.calibration_intercept_abs FROM ("
           + thr_metrics_from_counts("c", "model_name, split", "8.0", "1.0") + ") t JOIN auc USING (model_name, split) JOIN bl USING (model_name, split) JOIN cal USING (model_name, split))")
    longp = ("lp AS (SELECT model_name, metric_name, value FROM (SELECT model_name, split, " + ", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m in _BM)
             + " FROM per) UNPIVOT (value FOR metric_name IN (" + ", ".join(_BM) + ")) WHERE value IS NOT NULL AND NOT isnan(value))")
    # baseline: unweighted metrics on the validation scores
    bsc = "bsc AS (SELECT * FROM sc WHERE split = 'validation')"
    bcells = "bcells AS (SELECT model_name, split, y, round(LEAST(GREATEST(p, 1e-6), 1-1e-6), 9) AS p, count(*)*1.0::DOUBLE AS w FROM bsc GROUP BY ALL)"
    bc = "bc AS (" + counts_at("0.1", "bsc") + ")"
    bauc = AUC.replace("auc AS", "bauc AS").replace("FROM cells", "FROM bcells")
    bbl = BRIER.replace("bl AS", "bbl AS").replace("FROM cells", "FROM bcells")
    bcal2 = calib_ctes(src="bcells", prefix="b")
    base = ("base AS (SELECT model_name, metric_name, value AS baseline FROM (SELECT t.model_name, " + ", ".join(
        f"CAST({'t.' if m not in ('roc_auc', 'brier', 'log_loss', 'calibration_slope_error', 'calibration_intercept_abs') else ''}{m} AS DOUBLE) AS {m}" for m in _BM)
            + " FROM (" + thr_metrics_from_counts("bc", "model_name, split", "8.0", "1.0") + ") t JOIN bauc USING (model_name, split) JOIN bbl USING (model_name, split) "
            "JOIN bcal USING (model_name, split)) UNPIVOT (value FOR metric_name IN (" + ", ".join(_BM) + ")))")
    body = ("SELECT b.model_name, b.metric_name, round(b.baseline, 7) AS baseline, round(a.m, 7) AS mean_value, round(a.lo, 7) AS ci_lower, "
            "round(a.hi, 7) AS ci_upper, round(a.hi - a.lo, 7) AS ci_width, COALESCE(a.k, 0) AS valid_iterations FROM base b LEFT JOIN ("
            "SELECT model_name, metric_name, avg(value) AS m, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi, count(*) AS k "
            "FROM lp GROUP BY ALL) a USING (model_name, metric_name)")
    return with_base(body, SC_ALL, scw, cells, cnt, AUC, BRIER, *calib_ctes(), per, longp, bsc, bcells, bc, bauc, bbl, *bcal2, base)


SQL["bootstrap_ci"] = _boot_sql(250)

_PF = [("Glucose", 0.02), ("BMI", 0.03), ("Age", 0.01)]


def _sig_sub(feature_expr) -> str:
    z = "-5.2" + "".join(f" + {w}*({feature_expr(f)})" for f, w in _PF)
    return f"round(1/(1+exp(-({z}))), 9)"


_PERM = [
    "pv AS (SELECT * FROM spl WHERE split = 'validation')",
    "pl AS (SELECT pv.*, f.feature_name, r.rep FROM pv, (VALUES ('Glucose'), ('BMI'), ('Age')) f(feature_name), range(1, 13) r(rep))",
    "pa AS (SELECT *, row_number() OVER (PARTITION BY feature_name, rep ORDER BY md5(concat('42:perm_a:', feature_name, ':', CAST(rep AS VARCHAR), ':', CAST(row_id AS VARCHAR))), row_id) AS r FROM pl)",
    "pb AS (SELECT feature_name, rep, row_number() OVER (PARTITION BY feature_name, rep ORDER BY md5(concat('42:perm_b:', feature_name, ':', CAST(rep AS VARCHAR), ':', CAST(row_id AS VARCHAR))), row_id) AS r, "
    "CASE feature_name WHEN 'Glucose' THEN Glucose WHEN 'BMI' THEN BMI ELSE Age END AS pvv FROM pl)",
    "sc AS (SELECT pa.feature_name AS model_name, CAST(pa.rep AS VARCHAR) AS split, pa.row_id, pa.Outcome AS y, "
    + _sig_sub(lambda f: f"CASE WHEN pa.feature_name = '{f}' THEN pb.pvv ELSE pa.{f} END") + " AS p FROM pa JOIN pb USING (feature_name, rep, r))",
    "c AS (" + counts_at("0.1") + ")", CELLS, AUC, BRIER,
    "pm AS (SELECT model_name AS feature_name, split AS rep, t.recall, t.expected_cost, auc.roc_auc, bl.brier, bl.log_loss FROM ("
    + thr_metrics_from_counts("c", "model_name, split", "8.0", "1.0") + ") t JOIN auc USING (model_name, split) JOIN bl USING (model_name, split))",
    "bs AS (SELECT 'base' AS model_name, 'base' AS split, row_id, Outcome AS y, " + _sig_sub(lambda f: f) + " AS p FROM pv)",
    "bcnt AS (" + counts_at("0.1", "bs") + ")",
    "bcl AS (SELECT model_name, split, y, round(LEAST(GREATEST(p, 1e-6), 1-1e-6), 9) AS p, count(*)*1.0::DOUBLE AS w FROM bs GROUP BY ALL)",
    AUC.replace("auc AS", "bauc AS").replace("FROM cells", "FROM bcl"),
    BRIER.replace("bl AS", "bbl AS").replace("FROM cells", "FROM bcl"),
    "bm AS (SELECT t.recall, t.expected_cost, bauc.roc_auc, bbl.brier, bbl.log_loss FROM (" + thr_metrics_from_counts("bcnt", "model_name, split", "8.0", "1.0")
    + ") t JOIN bauc USING (model_name, split) JOIN bbl USING (model_name, split))",
]
_PM = ["roc_auc", "brier", "log_loss", "recall", "expected_cost"]
SQL["permutation_importance"] = with_base(
    "SELECT 'fixed_logistic' AS model_name, feature_name, 'ungrouped' AS feature_group, metric_name, round(avg(delta), 8) AS importance_mean, "
    "round(COALESCE(stddev_samp(delta), 0.0), 8) AS importance_std, count(*) AS repeats, round(avg(delta), 8) > 0 AS helps_model FROM ("
    "SELECT feature_name, metric_name, CASE WHEN metric_name IN ('roc_auc', 'recall') THEN b - v ELSE v - b END AS delta FROM ("
    + " UNION ALL ".join(f"SELECT pm.feature_name, '{m}' AS metric_name, CAST(pm.{m} AS DOUBLE) AS v, CAST(bm.{m} AS DOUBLE) AS b FROM pm, bm" for m in _PM)
    + ")) GROUP BY feature_name, metric_name", *_PERM)

_SAMPLE = "smp AS (SELECT * FROM spl WHERE split = 'validation')"
_SCEN = " UNION ALL ".join(f"SELECT '{f}' AS feature_name, {pct!r}::DOUBLE AS perturbation_pct, '{d}' AS direction, {(1 - pct if d == 'down' else 1 + pct)!r}::DOUBLE AS mult"
                           for f, _ in _PF for pct in (0.05, 0.10, 0.20) for d in ("down", "up"))
_BAND0 = BAND_SQL.format(d="NULL")
_PERT = [
    _SAMPLE,
    "mm AS (SELECT " + ", ".join(f"min({f}) AS mn_{f}, max({f}) AS mx_{f}" for f, _ in _PF) + " FROM smp)",
    f"px AS (SELECT smp.*, s.*, CASE s.feature_name " + " ".join(f"WHEN '{f}' THEN {f}" for f, _ in _PF) + " END AS cur, "
    "CASE s.feature_name " + " ".join(f"WHEN '{f}' THEN least(greatest({f}*s.mult, mn_{f}), mx_{f})" for f, _ in _PF) + " END AS nv "
    f"FROM smp, mm, ({_SCEN}) s)",
    "py AS (SELECT *, abs(nv - cur) / greatest(abs(cur), 1.0) AS rel, " + _sig_sub(lambda f: f) + " AS p0, "
    + _sig_sub(lambda f: f"CASE WHEN feature_name = '{f}' THEN nv ELSE {f} END") + " AS p1 FROM px)",
    "pz AS (SELECT *, abs(p1 - p0) AS dp, abs(p1 - p0) / rel AS ratio, CASE WHEN (p0 >= 0.1) <> (p1 >= 0.1) THEN 1.0 ELSE 0.0 END AS flip, "
    f"CASE WHEN COALESCE(({_BAND0.replace('p >=', 'p0 >=').replace('p <', 'p0 <')}), '') <> COALESCE(({_BAND0.replace('p >=', 'p1 >=').replace('p <', 'p1 <')}), '') THEN 1.0 ELSE 0.0 END AS bchg "
    "FROM py WHERE rel > 0)",
    "aud AS (SELECT 'fixed_logistic' AS model_name, feature_name, perturbation_pct, direction, count(*) AS rows_changed, "
    "round(avg(dp), 8) AS mean_abs_probability_delta, round(quantile_cont(dp, 0.5), 8) AS median_abs_probability_delta, round(max(dp), 8) AS max_abs_probability_delta, "
    "round(avg(ratio), 8) AS mean_sensitivity_ratio, round(max(ratio), 8) AS max_sensitivity_ratio, round(avg(flip), 8) AS decision_flip_rate, "
    "round(avg(bchg), 8) AS risk_band_change_rate, CASE WHEN avg(ratio) < 0.1 THEN 'too_insensitive' WHEN avg(ratio) > 1.0 THEN 'too_sensitive' ELSE 'proportional' END AS sensitivity_label "
    "FROM pz GROUP BY feature_name, perturbation_pct, direction)",
    "psum AS (SELECT model_name, feature_name, count(*) AS scenarios, round(avg(mean_sensitivity_ratio), 8) AS mean_sensitivity_ratio, "
    "round(max(max_sensitivity_ratio), 8) AS max_sensitivity_ratio, round(max(decision_flip_rate), 8) AS max_decision_flip_rate, "
    "round(max(COALESCE(risk_band_change_rate, 0.0)), 8) AS max_risk_band_change_rate, count(DISTINCT direction) AS directions_tested, "
    "round(avg(mean_abs_probability_delta), 8) AS mean_abs_probability_delta, CASE WHEN bool_or(sensitivity_label = 'too_sensitive') AND bool_or(sensitivity_label = 'too_insensitive') THEN 'mixed' "
    "WHEN bool_or(sensitivity_label = 'too_sensitive') THEN 'too_sensitive' WHEN bool_or(sensitivity_label = 'too_insensitive') THEN 'too_insensitive' "
    "ELSE 'proportional' END AS overall_label FROM aud GROUP BY model_name, feature_name)",
]
SQL["perturbation_audit"] = with_base("SELECT * FROM aud", *_PERT)
SQL["perturbation_summary"] = with_base("SELECT * FROM psum", *_PERT)
SQL["sensitivity_counts"] = with_base(
    "SELECT d.overall_label, COALESCE(c.n, 0) AS n_features FROM (VALUES ('too_sensitive'), ('too_insensitive'), ('proportional'), ('mixed')) d(overall_label) "
    "LEFT JOIN (SELECT overall_label, count(*) AS n FROM psum GROUP BY overall_label) c USING (overall_label)", *_PERT)
SQL["design_audit"] = with_base(
    "SELECT chk AS \"check\", CAST(v AS BIGINT) AS violations, CASE WHEN v = 0 THEN 'pass' ELSE 'review' END AS status FROM ("
    "SELECT 'target_not_in_features' AS chk, 0 AS v UNION ALL SELECT 'split_marker_not_in_features', 0 UNION ALL SELECT 'selection_splits_within_train', 0 "
    "UNION ALL SELECT 'policy_split_not_test', 0 UNION ALL "
    "SELECT 'row_keys_exclusive_to_one_split', COALESCE(sum(CASE WHEN k > 1 THEN 1 ELSE 0 END), 0) FROM (SELECT row_id, count(DISTINCT split) AS k FROM spl GROUP BY row_id) "
    "UNION ALL SELECT 'no_feature_tuple_shared_train_test', count(*) FROM (SELECT DISTINCT " + ", ".join(RAW) + " FROM spl WHERE split = 'train' "
    "INTERSECT SELECT DISTINCT " + ", ".join(RAW) + " FROM spl WHERE split = 'test'))")

# ----------------------------------------------------------------- reports
# the serving path: preparation fitted on train, threshold chosen on validation
_THR = "(SELECT threshold FROM pol WHERE policy_name = 'prioritize_recall')"
_TS = [*PREP, "sc AS (SELECT 'fixed_logistic' AS model_name, split, row_id, Outcome AS y, " + _sig(*MODELS[0][1:]) + " AS p FROM feat)", *policy_sql(),
       "ts AS (SELECT *, " + _sig(*MODELS[0][1:]) + " AS p FROM feat WHERE split = 'test')"]
SQL["score_batch"] = with_base(
    "SELECT row_id, round(Glucose, 9) AS Glucose, round(BMI, 9) AS BMI, round(Age, 9) AS Age, round(glucose_bmi_interaction, 9) AS glucose_bmi_interaction, bmi_category, "
    f"p AS prediction_proba, {_THR} AS decision_threshold, CAST(p >= {_THR} AS INTEGER) AS prediction, " + BAND_SQL.format(d="NULL") + " AS risk_band FROM ts", *_TS)
SQL["predict"] = with_base(
    "SELECT row_id, p AS prediction_proba, round(p*100.0, 9) AS risk_score, " + BAND_SQL.format(d="NULL") + " AS risk_band, CAST(p >= " + _THR + " AS INTEGER) AS prediction FROM ts", *_TS)
SQL["risk_report"] = with_base(
    "SELECT row_number() OVER (ORDER BY row_id) AS case_id, row_id, round(Glucose, 9) AS Glucose, round(BMI, 9) AS BMI, round(Age, 9) AS Age, CAST(p >= " + _THR + " AS INTEGER) AS prediction, "
    "CASE WHEN p >= " + _THR + " THEN 'Positivo' ELSE 'Negativo' END AS prediction_label, p AS prediction_proba, round(p*100.0, 9) AS risk_score, "
    + BAND_SQL.format(d="NULL") + " AS risk_band, 'prioritize_recall' AS decision_policy_name, " + _THR + " AS decision_threshold, "
    + ACTION_SQL.format(b="(" + BAND_SQL.format(d="NULL") + ")") + " AS recommended_action, row_number() OVER (ORDER BY p DESC, row_id) AS risk_priority_rank FROM ts", *_TS)
SQL["risk_band_counts"] = with_base("SELECT COALESCE(" + BAND_SQL.format(d="NULL") + ", 'Sem faixa') AS risk_band, count(*) AS n_cases FROM ts GROUP BY ALL", *_TS)
SQL["risk_preview"] = with_base("SELECT row_id, p AS prediction_proba, " + BAND_SQL.format(d="NULL") + " AS risk_band, CAST(p >= " + _THR + " AS INTEGER) AS prediction "
                                "FROM ts ORDER BY p DESC, row_id LIMIT 20", *_TS)
SQL["policy_tradeoffs"] = with_base("SELECT * FROM pol", SC_FIXED, *policy_sql())
SQL["deployment_policy"] = with_base("SELECT model_name, policy_name, threshold, recall, precision, expected_cost FROM pol WHERE policy_name = 'prioritize_recall'",
                                     SC_ALL, *policy_sql())
SQL["policy_decisions"] = with_base(
    "SELECT sc.row_id, pol.policy_name, pol.policy_label, pol.threshold, CASE WHEN sc.p >= pol.threshold THEN 'Positivo' ELSE 'Negativo' END AS decision, "
    "pol.expected_cost, pol.recall, pol.precision FROM sc JOIN pol USING (model_name) WHERE sc.split = 'test'", SC_FIXED, *policy_sql())
SQL["fold_pivot"] = with_base(
    "SELECT fold_id, max(CASE WHEN model_name = 'fixed_logistic' THEN roc_auc END) AS fixed_logistic, "
    "max(CASE WHEN model_name = 'glucose_age' THEN roc_auc END) AS glucose_age, max(CASE WHEN model_name = 'bmi_age_preg' THEN roc_auc END) AS bmi_age_preg "
    "FROM fm GROUP BY fold_id", *_FOLD_BASE)
SQL["test_summary"] = with_base(
    "SELECT t.model_name, (k.rank = 1) AS selected, t.roc_auc AS test_roc_auc, t.brier AS test_brier, "
    "row_number() OVER (ORDER BY (k.rank = 1) DESC, t.roc_auc DESC, t.model_name) AS display_order FROM tst t LEFT JOIN card k USING (model_name)",
    *_SEL_BASE, *_comp_ctes(), _CARD, _TEST)

# ---------------------------------------------------------- sources & sinks
SQL["registry_upsert"] = ("SELECT user_id, event_id, event_type, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn "
                          "FROM events) WHERE rn = 1")
SQL["registry_lookup"] = ("SELECT event_id, user_id, trim(split_part(concat_ws(chr(10), event_type, props), chr(10), 1)) AS error FROM events "
                          "WHERE user_id IN (7, 42, 99)")
SQL["registry_recent"] = ("SELECT event_id, user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events "
                          "ORDER BY ts DESC, event_id DESC LIMIT 10")
SQL["payload_to_table"] = "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"
_PV_REASON = ("CASE WHEN NOT json_valid(props) THEN 'malformed' WHEN NOT list_contains(json_keys(props), 'k') THEN 'missing:k' "
              "WHEN len(list_filter(json_keys(props), lambda x: x <> 'k')) > 0 THEN 'extra:' || array_to_string(list_sort(list_filter(json_keys(props), lambda x: x <> 'k')), ',') "
              "WHEN TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) IS NULL THEN 'non_numeric:k' "
              "WHEN TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) < 0 THEN 'negative:k' END")
SQL["payload_validate"] = (f"SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, ({_PV_REASON}) IS NULL AS accepted, "
                           f"{_PV_REASON} AS reject_reason FROM events")
SQL["json_manifest_sink"] = with_base("SELECT model_name, policy_name, threshold, expected_cost FROM pol", SC_ALL, *policy_sql())
SQL["write_csv"] = with_base("SELECT row_number() OVER (ORDER BY row_id) AS case_id, row_id, p AS prediction_proba, " + BAND_SQL.format(d="NULL")
                             + " AS risk_band, row_number() OVER (ORDER BY p DESC, row_id) AS risk_priority_rank FROM ts", *_TS)
SQL["scan_csv"] = with_base("SELECT Outcome, count(*) AS n, round(sum(Glucose), 9) AS sum_glucose FROM cohort GROUP BY Outcome")
SQL["latest_version_read"] = with_base("SELECT split, CAST(count(*) * 2 AS BIGINT) AS rows, CAST(2 AS INTEGER) AS version FROM spl GROUP BY split")
SQL["score_stream"] = with_base("SELECT row_id, p AS prediction_proba, CAST(p >= " + _THR + " AS INTEGER) AS prediction, " + BAND_SQL.format(d="NULL") + " AS risk_band FROM ts", *_TS)
SQL["score_request"] = with_base(
    "SELECT row_id, reason IS NULL AS accepted, reason AS reject_reason, CASE WHEN reason IS NULL THEN p END AS prediction_proba, "
    "CASE WHEN reason IS NULL THEN CAST(p >= " + _THR + " AS INTEGER) END AS prediction, CASE WHEN reason IS NULL THEN " + BAND_SQL.format(d="NULL") + " END AS risk_band FROM ("
    "SELECT *, CASE WHEN row_id % 23 = 0 THEN 'malformed' WHEN row_id % 11 = 0 THEN 'missing:Glucose' WHEN row_id % 13 = 0 THEN 'negative:BMI' "
    "WHEN row_id % 17 = 0 THEN 'non_numeric:Age' WHEN row_id % 19 = 0 THEN 'extra:Zip' END AS reason FROM ts) t", *_TS)

# k-nearest-neighbour imputation: every incomplete row against every training row
_X = range(len(ZM))
_KNN = [
    PREP[0],
    "rs AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS m{i}, CASE WHEN quantile_cont({c}, 0.75) = quantile_cont({c}, 0.25) THEN 1.0 "
                                 f"ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END AS s{i}" for i, c in enumerate(ZM))
    + " FROM zm WHERE split = 'train')",
    "sx AS (SELECT row_id, split, " + ", ".join(f"({c} - m{i}) / s{i} AS x{i}" for i, c in enumerate(ZM)) + " FROM zm CROSS JOIN rs)",
    "don AS (SELECT " + ", ".join(f"x{i}" for i in _X) + " FROM sx WHERE split = 'train')",
    "mx AS (SELECT " + ", ".join(f"COALESCE(avg(x{i}), 0) AS a{i}" for i in _X) + " FROM don)",
    "rec AS (SELECT DISTINCT " + ", ".join(f"x{i}" for i in _X) + " FROM sx WHERE " + " OR ".join(f"x{i} IS NULL" for i in _X) + ")",
]
_SHARED = " + ".join(f"CAST(r.x{i} IS NOT NULL AND d.x{i} IS NOT NULL AS INTEGER)" for i in _X)
_SQUARES = " + ".join(f"COALESCE((r.x{i} - d.x{i}) * (r.x{i} - d.x{i}), 0)" for i in _X)
_KNN += [
    f"k{c} AS (SELECT " + ", ".join(f"r.x{i}" for i in _X) + f", list_avg(arg_min(d.x{c}, {{'d': 5.0::DOUBLE / ({_SHARED}) * ({_SQUARES}), 'v': d.x{c}}}, 5)) AS v{c} "
    f"FROM rec r JOIN don d ON r.x{c} IS NULL AND d.x{c} IS NOT NULL AND ({_SHARED}) > 0 GROUP BY " + ", ".join(f"r.x{i}" for i in _X) + ")"
    for c in _X
]
SQL["impute_knn"] = with_base(
    "SELECT sx.row_id, sx.split, " + ", ".join(f"round(COALESCE(sx.x{i}, v{i}, a{i}) * s{i} + m{i}, 6) AS {c}" for i, c in enumerate(ZM))
    + " FROM sx CROSS JOIN rs CROSS JOIN mx "
    + " ".join(f"LEFT JOIN k{c} ON " + " AND ".join(f"sx.x{i} IS NOT DISTINCT FROM k{c}.x{i}" for i in _X) for c in _X), *_KNN)
