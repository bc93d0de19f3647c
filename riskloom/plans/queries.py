"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each query reads the driver tables (through the cohort stand-in and the
library's operators) so its work grows with the input. Floating outputs are
rounded so an independent SQL engine can reproduce them exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.config import (
    CATEGORY_ORDERS,
    NO_BAND_LABEL,
    RISK_BANDS,
    DERIVED_NUMERICAL,
    POLICIES,
    RAW_NUMERICAL,
    RAW_ROLES,
    SPLIT_RATIOS,
    TARGET,
    ZERO_AS_MISSING,
)
from riskloom.functions import expressions as X
from riskloom.operators import features as feat
from riskloom.operators import impute_knn as knn
from riskloom.operators import metrics as M
from riskloom.operators import policy as P
from riskloom.operators import preprocess as pp
from riskloom.operators import split as split_ops
from riskloom.plans.pipeline import all_scorers, apply_prepared, fit_serving, prepared, score_batch, scores_table, split_cohort
from riskloom.sources.cohort import cohort
from riskloom.sources.tables import shared_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
KEYS = ["model_name", "split"]


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return deco


def r9(c):
    return F.round(c if not isinstance(c, str) else F.col(c), 9)


# ------------------------------------------------------------------ sources
@register("scan_parquet")
def q_scan_parquet(spark, sf_dir):
    return cohort(spark, sf_dir).withColumn("BMI", F.round("BMI", 9))


# ---------------------------------------------------------------- splitting
@register("split_stratified")
def q_split_stratified(spark, sf_dir):
    return split_cohort(spark, sf_dir).select("row_id", TARGET, "split")


@register("split_fallback")
def q_split_fallback(spark, sf_dir):
    """A stratum that the table doesn't have: the random split, with the reason."""
    rows, info = split_ops.split_with_fallback(cohort(spark, sf_dir), strat_col="Stratum")
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("rows")).select("split", "rows", F.lit(info["strategy_resolved"]).alias("strategy_resolved"), F.lit(info["reason"]).alias("reason"))


@register("holdout_inner")
def q_holdout_inner(spark, sf_dir):
    """Inner train / valid parts of each outer fold."""
    folded = split_ops.kfold_stratified(split_cohort(spark, sf_dir).filter(F.col("split") == "train"), TARGET, 4)
    return split_ops.holdout_inner(folded, TARGET, "fold_id").select("row_id", "fold_id", "inner_split")


@register("split_random")
def q_split_random(spark, sf_dir):
    return split_ops.split_random(cohort(spark, sf_dir), SPLIT_RATIOS, 42).select("row_id", "split")


@register("split_report")
def q_split_report(spark, sf_dir):
    return split_ops.split_report(split_cohort(spark, sf_dir), SPLIT_RATIOS)


@register("kfold_stratified")
def q_kfold(spark, sf_dir):
    dev = split_cohort(spark, sf_dir).filter(F.col("split").isin("train", "validation"))
    return split_ops.kfold_stratified(dev, TARGET, 4).select("row_id", TARGET, "fold_id")


@register("sample_n")
def q_sample_n(spark, sf_dir):
    val = split_cohort(spark, sf_dir).filter(F.col("split") == "validation")
    return split_ops.sample_n(val, 128, 42).select("row_id", "Glucose", TARGET)


# --------------------------------------------------- cleaning and features
@register("select_roles")
def q_select_roles(spark, sf_dir):
    return feat.select_roles(cohort(spark, sf_dir), RAW_ROLES, keep=["row_id"]).withColumns({c: r9(c) for c in ("Glucose", "BMI", "Age")})


@register("clean_coerce")
def q_clean_coerce(spark, sf_dir):
    # raw values arrive as text (CSV semantics); zeros in Glucose are blanked to exercise coercion
    raw = cohort(spark, sf_dir).select(
        "row_id",
        *[(F.when(F.col(c) == 0, F.lit("")).otherwise(F.col(c).cast("string")) if c == "Glucose" else F.col(c).cast("string")).alias(c)
          for c in RAW_NUMERICAL],
        F.col(TARGET),
    )
    return feat.coerce_report(raw, RAW_ROLES)


@register("zero_as_missing")
def q_zero_as_missing(spark, sf_dir):
    return feat.zeros_to_missing(cohort(spark, sf_dir), ZERO_AS_MISSING).select("row_id", *[r9(c).alias(c) for c in ZERO_AS_MISSING])


def _featured_raw(spark, sf_dir):
    return feat.feature_build(feat.zeros_to_missing(cohort(spark, sf_dir), ZERO_AS_MISSING))


@register("feature_build")
def q_feature_build(spark, sf_dir):
    f = _featured_raw(spark, sf_dir)
    return f.select("row_id", *[r9(c).alias(c) for c in DERIVED_NUMERICAL], *CATEGORY_ORDERS)


@register("interactions")
def q_interactions(spark, sf_dir):
    f = _featured_raw(spark, sf_dir)
    return f.groupBy().agg(*[r9(F.sum(c)).alias(f"sum_{c}") for c in DERIVED_NUMERICAL],
                           *[F.count(c).alias(f"n_{c}") for c in DERIVED_NUMERICAL])


def _category_counts(spark, sf_dir, col):
    return _featured_raw(spark, sf_dir).groupBy(F.col(col).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@register("bin_cut")
def q_bin_cut(spark, sf_dir):
    f = _featured_raw(spark, sf_dir)
    return f.groupBy("bmi_category", "glucose_category").agg(F.count(F.lit(1)).alias("n"))


@register("threshold_category")
def q_threshold_category(spark, sf_dir):
    return _category_counts(spark, sf_dir, "age_category")


@register("cross_category")
def q_cross_category(spark, sf_dir):
    return _category_counts(spark, sf_dir, "age_bmi_category")


@register("cascade_band")
def q_cascade_band(spark, sf_dir):
    return _category_counts(spark, sf_dir, "age_glucose_category")


@register("range_flag")
def q_range_flag(spark, sf_dir):
    return _category_counts(spark, sf_dir, "insulin_category")


# ------------------------------------------------------------ preprocessing
@register("impute_stat")
def q_impute_stat(spark, sf_dir):
    df = split_cohort(spark, sf_dir)
    med = pp.fit_impute_stat(df, ZERO_AS_MISSING, ("train",))
    return pp.transform_impute_stat(df, med).select("row_id", "split", *[r9(c).alias(c) for c in ZERO_AS_MISSING])


@register("impute_knn")
def q_impute_knn(spark, sf_dir):
    """Missing clinical values of every row from its five nearest training rows."""
    df = split_cohort(spark, sf_dir)
    model = knn.fit_impute_knn(df, ZERO_AS_MISSING, ("train",))
    return knn.transform_impute_knn(df, model).select("row_id", "split", *[F.round(c, 6).alias(c) for c in ZERO_AS_MISSING])


@register("fit_robust_scale")
def q_fit_robust(spark, sf_dir):
    df = feat.zeros_to_missing(split_cohort(spark, sf_dir), ZERO_AS_MISSING)
    params = pp.fit_robust_scale(df, ZERO_AS_MISSING, ("train",))
    return spark.createDataFrame([(c, m, s) for c, (m, s) in params.items()], "feature string, median double, iqr double") \
        .select("feature", r9("median").alias("median"), r9("iqr").alias("iqr"))


def _imputed(spark, sf_dir):
    df = split_cohort(spark, sf_dir)
    return pp.transform_impute_stat(df, pp.fit_impute_stat(df, ZERO_AS_MISSING, ("train",)))


@register("fit_caps")
def q_fit_caps(spark, sf_dir):
    caps = pp.fit_caps(_imputed(spark, sf_dir), RAW_NUMERICAL, ("train",))
    return pp.caps_table(spark, caps).select("feature", r9("lower").alias("lower"), r9("upper").alias("upper"))


@register("clip_caps")
def q_clip_caps(spark, sf_dir):
    imp = _imputed(spark, sf_dir)
    caps = pp.fit_caps(imp, RAW_NUMERICAL, ("train",))
    return pp.transform_caps(imp, caps).select("row_id", *[r9(c).alias(c) for c in RAW_NUMERICAL])


@register("split_filter")
def q_split_filter(spark, sf_dir):
    return split_cohort(spark, sf_dir).filter(F.col("split").isin("train", "validation")).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), r9(F.avg("Glucose")).alias("avg_glucose"))


@register("fit_onehot")
def q_fit_onehot(spark, sf_dir):
    f, _ = prepared(spark, sf_dir)
    # no configured orders: categories are learned from the training rows
    cats = pp.fit_onehot(f, list(CATEGORY_ORDERS), ("train",), category_orders={})
    return spark.createDataFrame([(c, i + 1, v) for c, vals in cats.items() for i, v in enumerate(vals)],
                                 "feature string, position int, category string")


@register("transform_onehot")
def q_transform_onehot(spark, sf_dir):
    f, _ = prepared(spark, sf_dir)
    cats = pp.fit_onehot(f, list(CATEGORY_ORDERS), ("train",))
    enc = pp.transform_onehot(f, cats)
    cols = pp.onehot_columns(cats)
    return enc.groupBy("split").agg(*[F.sum(c).alias(c) for c in cols])


@register("fit_standard")
def q_fit_standard(spark, sf_dir):
    f, _ = prepared(spark, sf_dir)
    params = pp.fit_standard(f, RAW_NUMERICAL + DERIVED_NUMERICAL, ("train",))
    return pp.standard_table(spark, params).select("feature", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"))


@register("transform_standard")
def q_transform_standard(spark, sf_dir):
    f, _ = prepared(spark, sf_dir)
    params = pp.fit_standard(f, RAW_NUMERICAL, ("train",))
    out = pp.transform_standard(f, params)
    return out.groupBy("split").agg(*[(F.round(F.avg(c), 6) + F.lit(0.0)).alias(c) for c in RAW_NUMERICAL])


@register("fit_label_encoder")
def q_label_encoder(spark, sf_dir):
    return pp.fit_label_encoder(split_cohort(spark, sf_dir).filter(F.col("split") == "train"), TARGET)


@register("class_weights")
def q_class_weights(spark, sf_dir):
    tr = split_cohort(spark, sf_dir).filter(F.col("split") == "train")
    return pp.class_weights(tr, TARGET, "balanced").withColumn("weight", r9("weight"))


# ------------------------------------------------------------ scalar ops
@register("clip_probability")
def q_clip_probability(spark, sf_dir):
    s = scores_table(spark, sf_dir)
    return s.select("row_id", r9(X.clip_probability(F.col("p") * 1.5 - 0.25)).alias("p_clipped"))


@register("decide")
def q_decide(spark, sf_dir):
    s = scores_table(spark, sf_dir)
    return s.groupBy(X.decide("p", 0.5).alias("decision")).agg(F.count(F.lit(1)).alias("n"))


@register("risk_band")
def q_risk_band(spark, sf_dir):
    s = scores_table(spark, sf_dir, all_scorers())
    return s.groupBy("model_name", X.risk_band("p", RISK_BANDS, NO_BAND_LABEL).alias("risk_band")) \
        .agg(F.count(F.lit(1)).alias("n"))


@register("recommended_action")
def q_recommended_action(spark, sf_dir):
    s = scores_table(spark, sf_dir)
    band = X.risk_band("p", RISK_BANDS, None)
    return s.groupBy(X.recommended_action(band).alias("action")).agg(F.count(F.lit(1)).alias("n"))


@register("safe_divide")
def q_safe_divide(spark, sf_dir):
    c = cohort(spark, sf_dir)
    return c.select("row_id", r9(X.safe_divide(F.col("Glucose"), F.col("Insulin"))).alias("ratio"))


@register("relative_delta_pct")
def q_relative_delta(spark, sf_dir):
    c = split_cohort(spark, sf_dir)
    m = c.groupBy("split").agg(*[F.avg(col).alias(col) for col in RAW_NUMERICAL])
    whole = Window.partitionBy()  # one row per split: bounded
    j = m.select("split", *RAW_NUMERICAL, *[F.max(F.when(F.col("split") == "train", F.col(col))).over(whole).alias(f"ref_{col}")
                                            for col in RAW_NUMERICAL])
    return j.select("split", *[F.round(X.relative_delta_pct(F.col(col), F.col(f"ref_{col}")), 6).alias(col) for col in RAW_NUMERICAL]) \
        .filter(F.col("split") != "train")


# ------------------------------------------------------------------ metrics
@register("confusion_counts")
def q_confusion(spark, sf_dir):
    s = scores_table(spark, sf_dir, all_scorers())
    return M.threshold_metrics(s, KEYS, 0.5).select(*KEYS, "tn", "fp", "fn", "tp")


@register("threshold_metrics")
def q_threshold_metrics(spark, sf_dir):
    s = scores_table(spark, sf_dir, all_scorers())
    return M.threshold_metrics(s, KEYS, 0.5).drop("expected_cost", "expected_cost_per_sample")


@register("expected_cost")
def q_expected_cost(spark, sf_dir):
    s = scores_table(spark, sf_dir, all_scorers())
    return M.threshold_metrics(s, KEYS, 0.3, fn_cost=8.0, fp_cost=1.0).select(*KEYS, "expected_cost", "expected_cost_per_sample")


@register("roc_auc")
def q_roc_auc(spark, sf_dir):
    s = scores_table(spark, sf_dir, all_scorers())
    return M.roc_auc(M.to_cells(s, KEYS), KEYS)


@register("brier_log_loss")
def q_brier(spark, sf_dir):
    s = scores_table(spark, sf_dir, all_scorers())
    return M.brier_logloss(M.to_cells(s, KEYS), KEYS)


@register("calibration_fit")
def q_calibration(spark, sf_dir):
    s = scores_table(spark, sf_dir, all_scorers())
    return M.calibration_fit(M.to_cells(s, KEYS), KEYS).drop("converged")


@register("evaluate_all_splits")
def q_evaluate(spark, sf_dir):
    s = scores_table(spark, sf_dir, all_scorers())
    return M.metric_payload(s, KEYS, 0.5)


@register("evaluate")
def q_evaluate_full(spark, sf_dir):
    """Every metric of each model and split; the last split has no rows."""
    return M.evaluate(scores_table(spark, sf_dir, all_scorers()), ["train", "validation", "test", "holdout"])


# ----------------------------------------------------------------- policies
@register("threshold_grid")
def q_threshold_grid(spark, sf_dir):
    # the grid is a dimension; joined to the validation score range to read the data
    grid = P.grid_values()
    s = scores_table(spark, sf_dir).filter(F.col("split") == "validation")
    stats = s.agg(F.min("p").alias("pmin"), F.max("p").alias("pmax"))
    g = stats.select("pmin", "pmax", F.posexplode(F.array(*[F.lit(t) for t in grid])).alias("i", "threshold"))
    return g.select((F.col("i") + 1).cast("int").alias("threshold_index"), "threshold",
                    ((F.col("threshold") >= F.col("pmin")) & (F.col("threshold") <= F.col("pmax"))).alias("within_range"))


@register("threshold_sweep")
def q_threshold_sweep(spark, sf_dir):
    s = scores_table(spark, sf_dir, all_scorers())
    return P.threshold_sweep(s, KEYS)


@register("policy_select")
def q_policy_select(spark, sf_dir):
    s = scores_table(spark, sf_dir, all_scorers()).filter(F.col("split") == "validation")
    return P.policy_select(s, ["model_name"], POLICIES)


# ------------------------------------------------------------ data quality
from riskloom.config import BOOTSTRAP_ITERATIONS, DEPLOYMENT_POLICY, FIXED_SCORER, PERMUTATION_REPEATS, PERTURBATION_PERCENTS  # noqa: E402
from riskloom.operators import quality as Q  # noqa: E402
from riskloom.operators import robustness as R  # noqa: E402
from riskloom.operators import selection as S  # noqa: E402
from riskloom.operators.inference import predict, risk_band_counts, risk_report  # noqa: E402
from riskloom.operators.inference import linear_score  # noqa: E402


def _cleaned(spark, sf_dir):
    return feat.clean_coerce_table(cohort(spark, sf_dir), RAW_ROLES, keep=["row_id"])


@register("validate_clean")
def q_validate_clean(spark, sf_dir):
    return Q.validate_clean(_cleaned(spark, sf_dir), RAW_ROLES, raise_on_critical=False)


@register("validate_split")
def q_validate_split(spark, sf_dir):
    """The report on rows of which some have no marker and some a wrong one."""
    split = F.when(F.col("row_id") % 97 == 0, F.lit(None)).when(F.col("row_id") % 89 == 0, "tets").otherwise(F.col("split"))
    return Q.validate_split(split_cohort(spark, sf_dir).withColumn("split", split), raise_on_critical=False)


@register("minority_ratio")
def q_minority_ratio(spark, sf_dir):
    return Q.minority_ratio(split_cohort(spark, sf_dir), TARGET)


@register("contract_report")
def q_contract_report(spark, sf_dir):
    return Q.contract_report(_cleaned(spark, sf_dir), RAW_ROLES)


FRESHNESS_AS_OF = "2024-02-05 00:00:00"


@register("freshness_report")
def q_freshness(spark, sf_dir):
    from riskloom.sources.tables import table

    ev = table(spark, sf_dir, "events")
    return Q.freshness_report(ev, "ts", FRESHNESS_AS_OF, group_col="event_type")


@register("drift_psi")
def q_drift_psi(spark, sf_dir):
    f, _ = prepared(spark, sf_dir)
    return Q.drift_psi(f, RAW_NUMERICAL + DERIVED_NUMERICAL)


# ----------------------------------------------------------- model selection
def _payloads(spark, sf_dir, compat=False):
    s = scores_table(spark, sf_dir, all_scorers())
    val = S.validation_payload(s)
    pol = S.policy_payload(s, POLICIES, DEPLOYMENT_POLICY)
    return s, val, pol


@register("composite_score")
def q_composite(spark, sf_dir):
    _, val, pol = _payloads(spark, sf_dir)
    c = S.composite_score(val, pol)
    return c.select("model_name", "metric", "source", "direction", "weight", r9("raw_value").alias("raw_value"),
                    r9("utility").alias("utility"), r9("composite_score").alias("composite_score"))


@register("composite_score_compat")
def q_composite_compat(spark, sf_dir):
    _, val, pol = _payloads(spark, sf_dir)
    c = S.composite_score(val, pol, compat=True)
    return c.groupBy("model_name").agg(r9(F.first("composite_score")).alias("composite_score"))


@register("scorecard")
def q_scorecard(spark, sf_dir):
    _, val, pol = _payloads(spark, sf_dir)
    card = S.scorecard(val, pol)
    return card.select("model_name", "rank", r9("composite_score").alias("composite_score"), "roc_auc", "brier", "log_loss",
                       "calibration_slope_error", "policy_name", "policy_threshold", "policy_recall", "policy_expected_cost_per_sample")


@register("select_best")
def q_select_best(spark, sf_dir):
    _, val, pol = _payloads(spark, sf_dir)
    return S.select_best(S.scorecard(val, pol)).select("model_name", "policy_name", "policy_threshold", r9("composite_score").alias("composite_score"))


@register("model_frontier")
def q_model_frontier(spark, sf_dir):
    _, val, pol = _payloads(spark, sf_dir)
    return S.model_frontier(S.scorecard(val, pol), val)


@register("split_comparison")
def q_split_comparison(spark, sf_dir):
    """The chosen model on every split, at its policy's threshold and costs."""
    s, val, pol = _payloads(spark, sf_dir)
    best = S.select_best(S.scorecard(val, pol)).select("model_name", "policy_name", "policy_threshold").head()
    costs = next(p for p in POLICIES if p.name == best.policy_name)
    return S.split_comparison(s, best.model_name, best.policy_name, best.policy_threshold, costs.fn_cost, costs.fp_cost)


# -------------------------------------------------------------- robustness
def _fold_scores(spark, sf_dir):
    dev = split_cohort(spark, sf_dir).filter(F.col("split").isin("train", "validation"))
    folded = shared_table(split_ops.kfold_stratified(dev, TARGET, 4), "folds")
    return scores_table(spark, sf_dir, all_scorers(), base=folded.withColumn("split", F.col("fold_id").cast("string")))


@register("cv_fold_metrics")
def q_cv_fold_metrics(spark, sf_dir):
    s = _fold_scores(spark, sf_dir).withColumnRenamed("split", "fold_id")
    return M.metric_payload(s, ["model_name", "fold_id"], 0.10, fn_cost=8.0, fp_cost=1.0)


@register("cv_summary")
def q_cv_summary(spark, sf_dir):
    s = _fold_scores(spark, sf_dir).withColumnRenamed("split", "fold_id")
    return R.cv_summary(M.metric_payload(s, ["model_name", "fold_id"], 0.10, fn_cost=8.0, fp_cost=1.0))


@register("bootstrap_ci")
def q_bootstrap(spark, sf_dir):
    s = scores_table(spark, sf_dir, all_scorers()).filter(F.col("split") == "validation")
    return R.bootstrap_ci(s, iterations=BOOTSTRAP_ITERATIONS, threshold=0.10, fn_cost=8.0, fp_cost=1.0)


@register("permutation_importance")
def q_permutation(spark, sf_dir):
    val = split_cohort(spark, sf_dir).filter(F.col("split") == "validation")
    return R.permutation_importance(val, FIXED_SCORER, repeats=PERMUTATION_REPEATS, threshold=0.10, fn_cost=8.0, fp_cost=1.0)


def _sens_sample(spark, sf_dir):
    """The whole validation split; a smaller sample is a choice of the operator's caller."""
    return split_cohort(spark, sf_dir).filter(F.col("split") == "validation")


@register("perturbation_audit")
def q_perturbation(spark, sf_dir):
    return R.perturbation_audit(_sens_sample(spark, sf_dir), FIXED_SCORER, PERTURBATION_PERCENTS, 0.10)


@register("perturbation_summary")
def q_perturbation_summary(spark, sf_dir):
    return R.perturbation_summary(R.perturbation_audit(_sens_sample(spark, sf_dir), FIXED_SCORER, PERTURBATION_PERCENTS, 0.10))


@register("design_audit")
def q_design_audit(spark, sf_dir):
    return R.design_audit(split_cohort(spark, sf_dir), RAW_NUMERICAL, TARGET)


# ------------------------------------------------------- inference / reports
def _scored_test(spark, sf_dir):
    """Test rows through the fitted preparation, scored at the deployment policy's threshold."""
    return score_batch(spark, sf_dir)[0]


@register("score_batch")
def q_score_batch(spark, sf_dir):
    """The serving path as a user gets it: prepared features, probability, threshold and decision of each row."""
    scored, serving = score_batch(spark, sf_dir)
    return scored.select("row_id", *[r9(c).alias(c) for c in ("Glucose", "BMI", "Age", "glucose_bmi_interaction")], "bmi_category", "prediction_proba",
                         F.lit(serving.threshold).alias("decision_threshold"), "prediction", "risk_band")


@register("predict")
def q_predict(spark, sf_dir):
    return _scored_test(spark, sf_dir).select("row_id", "prediction_proba", r9("risk_score").alias("risk_score"), "risk_band", "prediction")


@register("risk_report")
def q_risk_report(spark, sf_dir):
    scored, serving = score_batch(spark, sf_dir)
    rep = risk_report(scored, DEPLOYMENT_POLICY, serving.threshold, ["Glucose", "BMI", "Age"])
    return rep.withColumn("risk_score", r9("risk_score")).withColumns({c: r9(c) for c in ("Glucose", "BMI", "Age")})


@register("risk_band_counts")
def q_risk_band_counts(spark, sf_dir):
    return risk_band_counts(_scored_test(spark, sf_dir))


@register("risk_preview")
def q_risk_preview(spark, sf_dir):
    sc = _scored_test(spark, sf_dir)
    top = sc.orderBy(F.col("prediction_proba").desc(), F.col("row_id")).limit(20)
    return top.select("row_id", "prediction_proba", "risk_band", "prediction")


@register("policy_tradeoffs")
def q_policy_tradeoffs(spark, sf_dir):
    s = scores_table(spark, sf_dir).filter(F.col("split") == "validation")
    return P.policy_select(s, ["model_name"], POLICIES)


@register("deployment_policy")
def q_deployment_policy(spark, sf_dir):
    s = scores_table(spark, sf_dir, all_scorers()).filter(F.col("split") == "validation")
    sel = P.policy_select(s, ["model_name"], POLICIES)
    return P.deployment_row(sel, ["model_name"], DEPLOYMENT_POLICY, [p.name for p in POLICIES]).select(
        "model_name", "policy_name", "threshold", "recall", "precision", "expected_cost")


@register("policy_decisions")
def q_policy_decisions(spark, sf_dir):
    """Each test score under each policy's chosen threshold (policies: a generator over a bounded list)."""
    s = scores_table(spark, sf_dir)
    sel = P.policy_select(s.filter(F.col("split") == "validation"), ["model_name"], POLICIES)
    catalog = sel.select("model_name", "policy_name", "policy_label", "threshold", "expected_cost", "recall", "precision")
    test = s.filter(F.col("split") == "test")
    d = test.join(F.broadcast(catalog), "model_name")  # <= models x policies rows
    lab = F.when(F.col("p") >= F.col("threshold"), F.lit("Positivo")).otherwise(F.lit("Negativo"))
    return d.select("row_id", "policy_name", "policy_label", "threshold", lab.alias("decision"), "expected_cost", "recall", "precision")


@register("fold_pivot")
def q_fold_pivot(spark, sf_dir):
    s = _fold_scores(spark, sf_dir).withColumnRenamed("split", "fold_id")
    fm = M.metric_payload(s, ["model_name", "fold_id"], 0.10, fn_cost=8.0, fp_cost=1.0)
    names = [sc.name for sc in all_scorers()]
    return fm.groupBy("fold_id").pivot("model_name", names).agg(F.first("roc_auc"))


@register("test_summary")
def q_test_summary(spark, sf_dir):
    s, val, pol = _payloads(spark, sf_dir)
    test = M.metric_payload(s.filter(F.col("split") == "test"), ["model_name"], 0.5)
    fr = test.join(S.scorecard(val, pol).select("model_name", "rank"), "model_name", "left")
    w = Window.orderBy(F.col("selected").desc(), F.col("test_roc_auc").desc(), F.col("model_name"))  # one row per model
    fr = fr.select("model_name", (F.col("rank") == 1).alias("selected"), F.col("roc_auc").alias("test_roc_auc"), F.col("brier").alias("test_brier"))
    return fr.select("*", F.row_number().over(w).alias("display_order"))


@register("sensitivity_counts")
def q_sensitivity_counts(spark, sf_dir):
    aud = R.perturbation_audit(_sens_sample(spark, sf_dir), FIXED_SCORER, PERTURBATION_PERCENTS, 0.10)
    summ = R.perturbation_summary(aud)
    dim = spark.createDataFrame([(x,) for x in ["too_sensitive", "too_insensitive", "proportional", "mixed"]], "overall_label string")
    cnt = summ.groupBy("overall_label").agg(F.count(F.lit(1)).alias("n_features"))
    return F.broadcast(dim).join(cnt, "overall_label", "left").select("overall_label", F.coalesce("n_features", F.lit(0)).alias("n_features"))


# --------------------------------------------------------- sources & sinks
from riskloom.sources import registry as REG  # noqa: E402
from riskloom.sources import tables as TB  # noqa: E402

_REG_CUTOFF = "2024-01-15 00:00:00"


def _events(spark, sf_dir):
    return TB.table(spark, sf_dir, "events")


@register("registry_upsert")
def q_registry_upsert(spark, sf_dir):
    ev = _events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type", "props")
    old = ev.filter(F.col("ts") < F.lit(_REG_CUTOFF).cast("timestamp_ntz"))
    new = ev.filter(F.col("ts") >= F.lit(_REG_CUTOFF).cast("timestamp_ntz"))
    return REG.registry_upsert(old, new, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "props")


@register("registry_lookup")
def q_registry_lookup(spark, sf_dir):
    ev = _events(spark, sf_dir).select("event_id", "user_id", F.concat_ws("\n", "event_type", "props").alias("error"))
    return REG.registry_lookup(ev, "user_id", [7, 42, 99], error_col="error")


@register("registry_recent")
def q_registry_recent(spark, sf_dir):
    ev = _events(spark, sf_dir)
    rec = REG.registry_recent(ev, "ts", 10, "props", "k long", tie_col="event_id")
    return rec.select("event_id", "user_id", "event_type", F.col("payload.k").alias("k"))


@register("payload_to_table")
def q_payload_to_table(spark, sf_dir):
    ev = _events(spark, sf_dir)
    return REG.payload_to_table(ev, "props", T_SCHEMA_K).select("k")


@register("payload_validate")
def q_payload_validate(spark, sf_dir):
    ev = _events(spark, sf_dir)
    return REG.payload_validate(ev, "props", ["k"], key_cols=["event_id"])


@register("json_manifest_sink")
def q_json_manifest(spark, sf_dir):
    s = scores_table(spark, sf_dir, all_scorers()).filter(F.col("split") == "validation")
    sel = P.policy_select(s, ["model_name"], POLICIES).select("model_name", "policy_name", "threshold", "expected_cost")
    man = TB.json_manifest(sel)
    schema = "array<struct<model_name:string,policy_name:string,threshold:double,expected_cost:double>>"
    return man.select(F.inline(F.from_json("manifest_json", schema)))


@register("write_csv")
def q_write_csv(spark, sf_dir):
    rep = q_risk_report(spark, sf_dir).select("case_id", "row_id", "prediction_proba", "risk_band", "risk_priority_rank")
    path = REG.sink_dir(spark, "risk_report_csv")
    TB.write_csv(rep, path)
    schema = "case_id long, row_id long, prediction_proba double, risk_band string, risk_priority_rank long"
    return spark.read.schema(schema).option("header", True).csv(path)


@register("scan_csv")
def q_scan_csv(spark, sf_dir):
    raw = cohort(spark, sf_dir).select(*RAW_NUMERICAL, TARGET)
    path = REG.sink_dir(spark, "raw_csv")
    TB.write_csv(raw, path)
    return TB.scan_csv(spark, path, TB.raw_schema()).groupBy(TARGET).agg(
        F.count(F.lit(1)).alias("n"), r9(F.sum("Glucose")).alias("sum_glucose"))


@register("latest_version_read")
def q_latest_version(spark, sf_dir):
    path = REG.sink_dir(spark, "versioned_split_report")
    rep = split_ops.split_report(split_cohort(spark, sf_dir), SPLIT_RATIOS)
    for v in (1, 2):
        rep.withColumn("version", F.lit(v)).withColumn("rows", F.col("rows") * v).write.mode("append").partitionBy("version").parquet(path)
    return TB.latest_version_read(spark, path).select("split", "rows", "version")


@register("file_inventory")
def q_file_inventory(spark, sf_dir):
    return REG.file_inventory(spark, f"{sf_dir.rstrip('/')}/*.parquet").select("path", "size_bytes")


from pyspark.sql import types as _T  # noqa: E402

T_SCHEMA_K = _T.StructType([_T.StructField("k", _T.LongType())])


# ----------------------------------------------------- training / streaming
from riskloom.plans import models as MD  # noqa: E402


def _train_logistic(spark, sf_dir):
    f, _ = prepared(spark, sf_dir)
    feats = RAW_NUMERICAL + DERIVED_NUMERICAL
    model = MD.train_model(f.filter(F.col("split") == "train"), feats, TARGET, "logistic", {"C": 1.0})
    return f, model


@register("train_model")
def q_train_model(spark, sf_dir):
    f, model = _train_logistic(spark, sf_dir)
    s = MD.score_model(model, f.filter(F.col("split").isin("validation", "test")), "logistic", TARGET)
    return M.metric_payload(s, KEYS, 0.5).select(*KEYS, "roc_auc", "brier", "log_loss", "recall", "precision")


@register("calibrate_sigmoid")
def q_calibrate_sigmoid(spark, sf_dir):
    f, model = _train_logistic(spark, sf_dir)
    s = MD.score_model(model, f.filter(F.col("split").isin("validation", "test")), "logistic", TARGET)
    params = MD.platt_fit(s.filter(F.col("split") == "validation"))
    cal = MD.platt_apply(s.filter(F.col("split") == "test"), params)
    return M.metric_payload(cal, KEYS, 0.5).select(*KEYS, "roc_auc", "brier", "calibration_slope", "calibration_intercept")


@register("score_stream")
def q_score_stream(spark, sf_dir):
    """Requests (test rows) land as Parquet files; a Structured Streaming query scores them (availableNow).

    The stream carries rejected requests with their reason; this query returns the accepted ones.
    """
    from riskloom.streaming.score_stream import run_available_now, scored_stream

    src, rows = REG.sink_dir(spark, "requests"), split_cohort(spark, sf_dir)
    rows.filter(F.col("split") == "test").select("row_id", *RAW_NUMERICAL).write.parquet(src)
    out, ck = REG.sink_dir(spark, "scored"), REG.sink_dir(spark, "scored_ckpt")
    run_available_now(scored_stream(spark, src, RAW_NUMERICAL, fit_serving(spark, sf_dir, rows=rows)), out, ck)
    return spark.read.parquet(out).filter("accepted").select("row_id", "prediction_proba", "prediction", "risk_band")


# --------------------------------------------------------- feature selection
from riskloom.operators import feature_select as FS  # noqa: E402

# The feature blocks of the reference configuration, and the blocks that some bring with them
FS_BLOCKS = {
    "pregnancies": ["Pregnancies"],
    "glucose_axis": ["Glucose"],
    "blood_pressure_axis": ["BloodPressure"],
    "skin_thickness_axis": ["SkinThickness"],
    "insulin_axis": ["Insulin"],
    "bmi_axis": ["BMI"],
    "pedigree_axis": ["DiabetesPedigreeFunction"],
    "age_axis": ["Age"],
    "engineered_continuous_signals": list(DERIVED_NUMERICAL),
    "clinical_categorical_signals": pp.onehot_columns(CATEGORY_ORDERS),
}
FS_REQUIRED = {
    "engineered_continuous_signals": ["glucose_axis", "bmi_axis", "insulin_axis", "pregnancies"],
    "clinical_categorical_signals": ["glucose_axis", "bmi_axis", "insulin_axis", "age_axis"],
}
FS_MAX_BLOCKS = 10


def _fs_inputs(spark, sf_dir):
    """All candidates on the prepared, encoded training rows."""
    split = split_cohort(spark, sf_dir)
    rows, fitted = prepared(spark, sf_dir, rows=split)
    # folds are dealt before the rows become wide
    folds = shared_table(split_ops.kfold_stratified(split.filter(F.col("split") == "train"), TARGET, 5, purpose="fs_fold"), "folds")
    folded = pp.transform_onehot(apply_prepared(folds, fitted), pp.fit_onehot(rows, list(CATEGORY_ORDERS), ("train",)))
    cands = FS.enumerate_candidates(FS_BLOCKS, 1, FS_MAX_BLOCKS, required=FS_REQUIRED)
    fm = FS.candidate_cv_linear(folded, cands, list(dict.fromkeys(f for b in FS_BLOCKS.values() for f in b)), TARGET)
    return fm, FS.candidates_frame(spark, cands)


@register("candidate_cv")
def q_candidate_cv(spark, sf_dir):
    fm, _ = _fs_inputs(spark, sf_dir)
    return fm


@register("fs_summary")
def q_fs_summary(spark, sf_dir):
    fm, cf = _fs_inputs(spark, sf_dir)
    return FS.fs_summary(fm, cf)


@register("fs_stability")
def q_fs_stability(spark, sf_dir):
    fm, cf = _fs_inputs(spark, sf_dir)
    return FS.fs_stability(fm, cf)


@register("score_request")
def q_score_request(spark, sf_dir):
    """Request payloads (JSON objects of the raw features), some of them wrong -> validate -> fitted preparation -> scores.

    Rejected requests stay, with the reason and without a score.
    """
    feats = list(RAW_NUMERICAL)
    good = [F.col(c) for c in feats]
    but = lambda name, value: [value.alias(c) if c == name else F.col(c) for c in feats]
    text = lambda columns: F.to_json(F.struct(*columns))
    k = F.col("row_id")
    payload = (F.when(k % 23 == 0, F.lit("{not json")).when(k % 11 == 0, text([F.col(c) for c in feats if c != "Glucose"])).when(k % 13 == 0, text(but("BMI", F.lit(-1.0))))
               .when(k % 17 == 0, text(but("Age", F.lit("old")))).when(k % 19 == 0, text([*good, F.lit(1).alias("Zip")])).otherwise(text(good)))
    rows = split_cohort(spark, sf_dir)
    req = rows.filter(F.col("split") == "test").select("row_id", payload.alias("payload"))
    checked = REG.payload_validate(req, "payload", feats, key_cols=["row_id"])
    ok = F.col("accepted")
    return fit_serving(spark, sf_dir, rows=rows).score(checked).select("row_id", "accepted", "reject_reason", *[F.when(ok, F.col(c)).alias(c) for c in ("prediction_proba", "prediction", "risk_band")])


from riskloom.plans import training_queries  # noqa: E402

QUERIES.update(training_queries.QUERIES)
