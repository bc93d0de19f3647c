"""Registered queries of search, calibration, refits, saved pipelines, bundles, fallbacks and streamed drift."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.config import DEPLOYMENT_POLICY, FIXED_SCORER, POLICIES, RAW_NUMERICAL, TARGET
from riskloom.operators import frames as FR
from riskloom.operators import logistic as L
from riskloom.operators import metrics as M
from riskloom.operators import policy as P
from riskloom.operators import split as split_ops
from riskloom.plans import fitted as FT
from riskloom.plans import search as SE
from riskloom.plans.pipeline import all_scorers, fit_serving, scores_table, split_cohort
from riskloom.sources import registry as REG
from riskloom.sources.tables import shared_table, table
from riskloom.streaming import drift_stream as DS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Parameters of the families that the per-fold refits compare.
FAMILIES = {"ridge": {"solver_penalty_combo": "l2__lbfgs", "C": 1.0}, "sparse": {"solver_penalty_combo": "l1__saga", "C": 0.05}, "free": {"solver_penalty_combo": "none__lbfgs"}}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _train(spark, sf_dir):
    return split_cohort(spark, sf_dir).filter(F.col("split") == "train")


def _fitted(spark, sf_dir, splits=("train",)):
    """Rows of the given splits, the pipeline that the training rows taught (its transform encodes and scales), and all rows."""
    rows = split_cohort(spark, sf_dir)
    return rows.filter(F.col("split").isin(*splits)), FT.fit_preparation(rows, ("train",)), rows


# ------------------------------------------------------------------- search
@register
def search_trials(spark, sf_dir):
    """The trials of all families with what is resolved from the training rows."""
    trials = SE.trial_table(_train(spark, sf_dir), TARGET)
    return trials.select("family", "trial", "parameter", F.round("number", 9).alias("number"), "choice")


@register
def search_tune(spark, sf_dir):
    """All trials of the regression family by their mean composite score over calibrated folds."""
    rows, fitted, _ = _fitted(spark, sf_dir)
    return SE.search_tune(rows, fitted.features(), TARGET, transform=fitted.transform).trials


@register
def calibrate_crossfit(spark, sf_dir):
    """Given fold scores of the training rows: a sigmoid for each fold, and the mean of the folds' sigmoids on the test rows."""
    rows = split_cohort(spark, sf_dir)
    folded = shared_table(split_ops.kfold_stratified(rows.filter(F.col("split") == "train"), TARGET, 5), "folds")
    held = scores_table(spark, sf_dir, base=folded.withColumn("split", F.col("fold_id").cast("string"))).withColumnRenamed("split", "fold_id")
    params = SE.sigmoid_params(M.to_cells(held, ["fold_id"]), ["fold_id"])
    test = scores_table(spark, sf_dir, base=rows).filter(F.col("split") == "test")
    return SE.calibrated_mean(test, params, ["row_id"]).withColumn("p", F.round("p", 7))


@register
def calibrate_trained(spark, sf_dir):
    """A regression trained on the training rows, cross-fitted: metrics of the test rows with and without its sigmoids."""
    rows, fitted, _ = _fitted(spark, sf_dir, ("train", "test"))
    features = fitted.features()
    folded = fitted.transform(split_ops.kfold_stratified(rows.filter(F.col("split") == "train"), TARGET, 5))
    test = fitted.transform(rows.filter(F.col("split") == "test"))
    parts = folded.select(F.col("fold_id").alias("part"), TARGET, *features).unionByName(test.select(F.lit(0).alias("part"), TARGET, *features))
    data = L.design(parts, features, TARGET, "part")
    spec = SE.regression({"solver_penalty_combo": "l2__lbfgs", "C": 1.0}, range(1, 6))
    models = SE.cross_fit(data, features, {"calibrated": (spec, [[i] for i in range(1, 6)]), "plain": (spec, [])})
    cells = SE.held_out_cells(data, features, models, {"calibrated": [0], "plain": [0]})
    return M.metric_payload(cells, ["model_name"], 0.5, w="w").select("model_name", "roc_auc", "brier", "log_loss", "calibration_slope", "calibration_intercept")


@register
def cv_fold_refits(spark, sf_dir):
    """Each family refitted on the other development folds: its metrics on each fold at the deployment threshold."""
    rows, fitted, every = _fitted(spark, sf_dir, ("train", "validation"))
    return SE.cv_fold_refits(rows, fitted.features(), TARGET, FAMILIES, threshold=fit_serving(spark, sf_dir, rows=every).threshold, transform=fitted.transform)


@register
def nested_parts(spark, sf_dir):
    """Rows and positives of each outer fold and quarter, with the part they play for every outer fold."""
    dev = split_cohort(spark, sf_dir).filter(F.col("split").isin("train", "validation"))
    counts = SE.nested_parts(dev, TARGET).groupBy("outer_fold", "quarter").agg(F.count(F.lit(1)).alias("rows"), F.sum(TARGET).alias("positives"))
    held = counts.withColumn("audited_fold", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])))
    role = F.when(F.col("outer_fold") == F.col("audited_fold"), "outer_test").when(F.col("quarter") == 1, "inner_validation").otherwise("inner_train")
    return held.groupBy("audited_fold", role.alias("role")).agg(F.sum("rows").alias("rows"), F.sum("positives").alias("positives"))


@register
def nested_cv_audit(spark, sf_dir):
    """What is chosen without each outer fold, and how it does on it."""
    rows, fitted, _ = _fitted(spark, sf_dir, ("train", "validation"))
    return SE.nested_cv_audit(rows, fitted.features(), TARGET, transform=fitted.transform)


# ------------------------------------------------------------ refit and save
def _numbers(fitted, spark):
    return fitted.parameters(spark).filter(F.col("step").isin("impute", "cap", "scale", "onehot")).select("step", "name", "position", F.round("number", 6).alias("number"), "text")


@register
def refit_production(spark, sf_dir):
    """Every fitted step, refitted on all splits."""
    return _numbers(FT.fit_preparation(split_cohort(spark, sf_dir), None), spark)


@register
def production_model(spark, sf_dir):
    """The production pipeline: steps refitted on all splits, a cross-fitted regression on them, and its decisions on the test rows."""
    rows = split_cohort(spark, sf_dir)
    fitted = FT.fit_preparation(rows, None)
    folded = fitted.transform(split_ops.kfold_stratified(rows, TARGET, 5))
    data = L.design(folded, fitted.features(), TARGET, "fold_id")
    spec = SE.regression({"solver_penalty_combo": "l2__lbfgs", "C": 1.0}, range(1, 6))
    model = SE.cross_fit(data, fitted.features(), {"production": (spec, [[i] for i in range(1, 6)])})["production"]
    served = fitted.with_model(model, "production", fit_serving(spark, sf_dir, rows=rows).threshold, DEPLOYMENT_POLICY)
    return served.score(rows.filter(F.col("split") == "test")).select("row_id", "prediction_proba", "prediction", "risk_band")


@register
def artifact_save_load(spark, sf_dir):
    """Test rows scored in a new session by a pipeline that was saved, published and loaded there."""
    rows = split_cohort(spark, sf_dir)
    serving = fit_serving(spark, sf_dir, rows=rows)
    fitted = FT.FittedPipeline(medians=serving.medians, caps=serving.caps, models=((FIXED_SCORER, 0.0, 1.0),), threshold=serving.threshold, policy=DEPLOYMENT_POLICY, encoded=False)
    path = REG.sink_dir(spark, "pipelines")
    FT.save(fitted, spark, path)
    loaded = FT.load(spark.newSession(), path)
    return loaded.score(rows.filter(F.col("split") == "test")).select("row_id", "prediction_proba", F.lit(loaded.threshold).alias("decision_threshold"), "prediction", "risk_band")


# ------------------------------------------------------- bundles, fallbacks
def _frontiers(spark, sf_dir):
    """Three families' frontiers of different columns: development metrics of each scorer by split."""
    s = scores_table(spark, sf_dir, all_scorers()).filter(F.col("split") != "test")
    t = M.threshold_metrics(s, ["model_name", "split"], 0.5)
    cells = M.to_cells(s, ["model_name", "split"])
    b = M.brier_logloss(cells, ["model_name", "split"])
    j = t.join(b, ["model_name", "split"])
    of = lambda name, *columns: j.filter(F.col("model_name") == name).select("split", *columns)
    names = [x.name for x in all_scorers()]
    return {names[0]: of(names[0], "brier", "log_loss", "tp"), names[1]: of(names[1], "brier", F.col("tp").cast("double").alias("tp")), names[2]: of(names[2], "brier", "recall", F.col("tp").cast("int").alias("tp"))}


@register
def union_tagged(spark, sf_dir):
    """Frames of different columns and types under one tag, which replaces a column of that name."""
    split = split_cohort(spark, sf_dir)
    frames = {"train": split.filter(F.col("split") == "train").select("row_id", "Glucose", F.col(TARGET).cast("int").alias(TARGET), "split"),
              "validation": split.filter(F.col("split") == "validation").select(F.col("row_id").cast("int").alias("row_id"), F.col("Glucose").cast("float").alias("Glucose"), "BMI")}
    return FR.union_tagged(frames, "split").select("row_id", F.round("Glucose", 6).alias("Glucose"), TARGET, F.round("BMI", 6).alias("BMI"), "split")


@register
def feature_bundle(spark, sf_dir):
    """The families' frontiers in one table, the winner (lowest validation Brier score) marked."""
    fr = _frontiers(spark, sf_dir)
    both = FR.union_tagged(fr, "model_name")
    winner = both.filter(F.col("split") == "validation").orderBy("brier", "model_name").head().model_name
    out, manifest = FR.feature_bundle(fr, winner, {n: i + 1 for i, n in enumerate(fr)})
    return out.select("model_name", "split", "brier", "log_loss", "recall", "tp", "selected_model_flag", F.lit(manifest["candidate_count"]).alias("candidate_count"))


@register
def config_match(spark, sf_dir):
    """Configurations of every tenth part, found among all parts' by class and parameters, whatever the keys' order and left-out defaults."""
    part = table(spark, sf_dir, "part")
    text = lambda *cols: F.to_json(F.struct(*cols))
    size, kind = F.col("p_size"), F.col("p_type")
    nested = lambda *cols: F.struct(*cols).alias("fit")
    ways = F.when(F.col("p_partkey") % 2 == 0, text(size.alias("size"), nested(kind.alias("kind"), F.lit(1).alias("depth")), F.lit("auto").alias("mode"))).otherwise(
        text(nested(F.lit(1.0).alias("depth"), kind.alias("kind")), size.cast("double").alias("size")))
    candidates = part.select("p_partkey", F.col("p_brand").alias("class_path"), ways.alias("params"), F.lit('{"mode": "auto", "size": 0}').alias("defaults"))
    wanted = candidates.filter(F.col("p_partkey") % 10 == 0).select(F.col("p_partkey").alias("wanted"), "class_path", "params", "defaults")
    return FR.config_match(wanted, candidates, "p_partkey", defaults="defaults").select("wanted", "matched", "n_matches")


@register
def selected_model_resolve(spark, sf_dir):
    """Each customer's orders as a frontier: the model that a policy names, else one of its class, else the one marked for refitting."""
    orders = table(spark, sf_dir, "orders")
    frontier = orders.select(F.col("o_custkey").alias("custkey"), F.concat(F.lit("m"), (F.col("o_orderkey") % 7).cast("string")).alias("model_name"),
                             F.concat(F.lit("c"), (F.col("o_orderkey") % 5).cast("string")).alias("class_path"), (F.col("o_orderkey") % 3 == 0).alias("selected_for_refit"), F.col("o_orderkey").alias("rank"))
    policies = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("m"), (F.col("c_custkey") % 7).cast("string"))).alias("model_name"),
                                                       F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("c"), (F.col("c_custkey") % 5).cast("string"))).alias("class_path"))
    return FR.selected_model_resolve(policies, frontier, ["custkey"]).select("custkey", "selected_model_name", "rule")


@register
def active_policy_row(spark, sf_dir):
    """Each model's row of the deployment policy, and of one that isn't there: the first row by the policies' order."""
    s = scores_table(spark, sf_dir, all_scorers()).filter(F.col("split") == "validation")
    order = F.array_position(F.array(*[F.lit(p.name) for p in POLICIES]), F.col("policy_name"))
    rows = P.policy_select(s, ["model_name"], POLICIES).select("model_name", "policy_name", "threshold", order.alias("policy_order"))
    wanted = rows.withColumn("wanted", F.explode(F.array(F.lit(DEPLOYMENT_POLICY), F.lit("absent"))))
    return FR.active_policy_row(wanted, ["model_name", "wanted"], F.col("wanted")).select("model_name", "wanted", "policy_name", "threshold", "rule")


@register
def diagnostic_threshold(spark, sf_dir):
    """The threshold that diagnostics use for each model and policy: the deployed one, the configured one, or one chosen afresh."""
    s = scores_table(spark, sf_dir, all_scorers()).filter(F.col("split") == "validation")
    fresh = P.policy_select(s, ["model_name"], POLICIES)
    deployed = P.deployment_row(fresh, ["model_name"], DEPLOYMENT_POLICY, [p.name for p in POLICIES]).filter(F.col("model_name") == FIXED_SCORER.name)
    deployed = deployed.select("model_name", "policy_name", F.col("threshold").alias("deployed"))
    configured = F.create_map(*[x for p in POLICIES if p.strategy == "fixed_threshold" for x in (F.lit(p.name), F.lit(float(p.threshold)))])
    j = fresh.join(F.broadcast(deployed), ["model_name", "policy_name"], "left")  # a row for each model at most
    value, rule = FR.diagnostic_threshold(F.col("deployed"), F.element_at(configured, F.col("policy_name")), F.col("threshold"))
    return j.select("model_name", "policy_name", value.alias("diagnostic_threshold"), rule.alias("rule"))


# -------------------------------------------------------------------- stream
DRIFT_UNTIL = "2024-01-08 00:00:00"


@register
def drift_stream(spark, sf_dir):
    """Daily drift of event values by type against the first week, counted by a stream over the events' files."""
    events = table(spark, sf_dir, "events").select("ts", "event_type", "value")
    reference = events.filter(F.col("ts") < F.lit(DRIFT_UNTIL).cast("timestamp"))
    edges = DS.reference_edges(reference, "value")
    source = REG.sink_dir(spark, "events")
    events.write.parquet(source)
    counts = DS.stream_counts(spark, source, events.schema, "ts", "value", edges, "event_type")
    sink, check = REG.sink_dir(spark, "drift"), REG.sink_dir(spark, "drift_checkpoint")
    DS.run_available_now(counts, sink, check)
    seen = spark.read.schema(counts.schema).parquet(sink)
    return DS.window_psi(seen, reference, "value", edges, "event_type")
