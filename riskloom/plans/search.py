"""Hyper-parameter search, cross-fitted calibration, per-fold refits and the nested audit.

A search space is declared as data; trials are drawn from md5 uniforms, so a trial's values
depend on its family, number and parameter only, never on the order of draws or on
partitions. All regressions that a search needs, over trials, folds and calibration folds,
are fitted by :mod:`riskloom.operators.logistic` in the same passes over one table of
folds. A training set is a set of folds: what is held out is in no set that the
scoring model, its calibration or its threshold learns from.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.config import DEPLOYMENT_POLICY, POLICIES, ROW_ID, SCORE_COMPONENTS, Policy
from riskloom.functions.hashing import keyed_md5, uniform01_fine
from riskloom.operators import logistic as L
from riskloom.operators import metrics as M
from riskloom.operators import policy as P
from riskloom.operators import selection as S
from riskloom.operators.ranking import rank_by_hash
from riskloom.operators.split import kfold_stratified
from riskloom.sources.tables import shared_table

# The search spaces, trials and folds of the reference configuration
_PENALISED = ["l2__lbfgs", "l2__liblinear", "l2__saga", "l2__newton-cg", "l1__liblinear", "l1__saga", "elasticnet__saga"]
SEARCH_SPACES: dict[str, dict[str, dict]] = {
    "baseline": {
        "solver_penalty_combo": {"type": "categorical", "choices": [*_PENALISED, "none__lbfgs", "none__newton-cg", "none__saga"]},
        "C": {"type": "float", "low": 0.0005, "high": 200.0, "log": True, "active_if": {"solver_penalty_combo": _PENALISED}},
        "l1_ratio": {"type": "float", "low": 0.05, "high": 0.95, "active_if": {"solver_penalty_combo": ["elasticnet__saga"]}},
        "fit_intercept": {"type": "categorical", "choices": [True, False]},
    },
    "optimized": {
        "depth": {"type": "int", "low": 3, "high": 10},
        "iterations": {"type": "int", "low": 100, "high": 500},
        "learning_rate": {"type": "float", "low": 0.01, "high": 0.3, "log": True},
        "l2_leaf_reg": {"type": "float", "low": 1.0, "high": 20.0, "log": True},
        "random_strength": {"type": "float", "low": 0.0, "high": 5.0},
        "bagging_temperature": {"type": "float", "low": 0.0, "high": 5.0},
        "border_count": {"type": "int", "low": 32, "high": 255},
    },
    "xgboost": {
        "n_estimators": {"type": "int", "low": 100, "high": 700},
        "max_depth": {"type": "int", "low": 2, "high": 10},
        "learning_rate": {"type": "float", "low": 0.01, "high": 0.3, "log": True},
        "min_child_weight": {"type": "int", "low": 1, "high": 10},
        "subsample": {"type": "float", "low": 0.6, "high": 1.0},
        "colsample_bytree": {"type": "float", "low": 0.6, "high": 1.0},
        "reg_alpha": {"type": "float", "low": 0.0, "high": 10.0},
        "reg_lambda": {"type": "float", "low": 0.5, "high": 20.0, "log": True},
        "gamma": {"type": "float", "low": 0.0, "high": 5.0},
    },
}
N_TRIALS = 60
CV_FOLDS = 5
# end of fixed values
#: Costs of the deployment policy, which the audits' thresholds are chosen by.
_POLICY = next(p for p in POLICIES if p.name == DEPLOYMENT_POLICY)


# ------------------------------------------------------------------ sampler
def _text(value) -> str:
    return str(value).lower() if isinstance(value, bool) else "null" if value is None else str(value)


def _choice(u: Column, choices: Sequence) -> Column:
    if not choices:
        raise ValueError("a categorical parameter needs choices")
    place = F.least(F.floor(u * len(choices)), F.lit(len(choices) - 1)).cast("int")
    return F.element_at(F.array(*[F.lit(_text(c)) for c in choices]), place + 1)


def sample_trials(spark: SparkSession, family: str, space: Mapping[str, Mapping], n_trials: int, seed: int = 42) -> DataFrame:
    """(family, trial, parameter, number, choice): a row for each active parameter of each trial.

    Types are int, float (with `log`), categorical, and conditional_categorical, whose choices depend on its
    `parent`'s value. A parameter with `active_if` is there only where all its parents have one of the listed values;
    parents are declared before. Categories are returned as text, numbers as doubles.
    """
    trials = spark.range(1, n_trials + 1).select(F.col("id").cast("int").alias("trial"))
    texts: dict[str, Column] = {}
    rows = []
    for name, config in space.items():
        kind = str(config["type"])
        u = uniform01_fine(seed, f"{family}:{name}", F.col("trial"))
        number, choice = F.lit(None).cast("double"), F.lit(None).cast("string")
        if kind == "int":
            low, high = int(config["low"]), int(config["high"])
            number = F.least(F.lit(low) + F.floor(u * (high - low + 1)), F.lit(high)).cast("double")
        elif kind == "float":
            low, high = float(config["low"]), float(config["high"])
            number = F.exp(F.log(F.lit(low)) + u * (F.log(F.lit(high)) - F.log(F.lit(low)))) if config.get("log") else F.lit(low) + u * (high - low)
        elif kind == "categorical":
            choice = _choice(u, list(config["choices"]))
        elif kind == "conditional_categorical":
            parent = texts[str(config["parent"])]
            for value, choices in config["choices_by_parent"].items():
                if not choices:
                    raise ValueError(f"no choices of {name} for {config['parent']} = {value}")
                choice = F.when(F.coalesce(parent, F.lit("null")) == _text(value), _choice(u, list(choices))).otherwise(choice)
        else:
            raise ValueError(f"unsupported type of parameter {name}: {kind}")
        active = F.lit(True)
        for parent, allowed in dict(config.get("active_if") or {}).items():
            active = active & F.coalesce(texts[parent].isin([_text(a) for a in allowed]), F.lit(False))
        texts[name] = F.when(active, F.coalesce(choice, number.cast("string")))
        rows.append(F.struct(F.lit(name).alias("parameter"), F.when(active, number).alias("number"), F.when(active, choice).alias("choice")))
    long = trials.select(F.lit(family).alias("family"), "trial", F.explode(F.array(*rows)).alias("p")).select("family", "trial", "p.*")
    return long.where("number is not null or choice is not null")


def trial_table(train: DataFrame, target: str, spaces: Mapping[str, Mapping] = SEARCH_SPACES, n_trials: int = N_TRIALS, folds: int = CV_FOLDS, seed: int = 42) -> DataFrame:
    """The trials of all families, with what is resolved from the training rows: folds that every class allows, and weights of the boosted families."""
    spark = train.sparkSession
    counts = train.where(F.col(target).isin(0, 1)).agg(*[F.count(F.when(F.col(target) == k, 1)).alias(f"n{k}") for k in (0, 1)])
    resolved = counts.select(
        F.least(F.lit(folds), F.col("n0"), F.col("n1")).cast("double").alias("cv_folds"),
        F.when(F.col("n1") > 0, F.col("n0") / F.col("n1")).otherwise(F.lit(1.0)).alias("scale_pos_weight"),
    )
    out = None
    for family, space in spaces.items():
        drawn = sample_trials(spark, family, space, n_trials, seed)
        names = ["cv_folds", *(["scale_pos_weight"] if family == "xgboost" else [])]
        # one row of counts, for each of a configured number of trials
        of_trial = resolved.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(n_trials))))
        fixed = of_trial.select("trial", F.explode(F.array(*[F.struct(F.lit(n).alias("parameter"), F.col(n).alias("number")) for n in names])).alias("p"))
        fixed = fixed.select(F.lit(family).alias("family"), "trial", "p.parameter", "p.number", F.lit(None).cast("string").alias("choice"))
        drawn = drawn.unionByName(fixed)
        out = drawn if out is None else out.unionByName(drawn)
    return out


# ------------------------------------------------------------ configurations
def canonical_params(params: Mapping, defaults: Mapping | None = None) -> str:
    """Text that equal configurations share: defaults merged in, keys in order at every depth, numbers by value."""

    def plain(value):
        if isinstance(value, Mapping):
            return {str(k): plain(v) for k, v in sorted(value.items(), key=lambda x: str(x[0]))}
        if isinstance(value, (list, tuple)):
            return [plain(v) for v in value]
        return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else value

    return json.dumps(plain({**(defaults or {}), **params}), sort_keys=True)


def params_of(rows: Sequence) -> dict[int, dict]:
    """Parameters of each trial from the (collected) rows of one family; their number is configured."""
    out: dict[int, dict] = {}
    for r in rows:
        out.setdefault(r.trial, {})[r.parameter] = r.number if r.choice is None else {"true": True, "false": False, "null": None}.get(r.choice, r.choice)
    return out


def regression(params: Mapping, parts: Sequence[int] = (), features: Sequence[str] | None = None) -> L.Spec:
    """The penalised regression of a trial of the baseline family; solvers of one penalty have the same optimum."""
    penalty = str(params.get("solver_penalty_combo", "l2__lbfgs")).split("__", 1)[0]
    ratio = {"l1": 1.0, "l2": 0.0, "none": 0.0, "elasticnet": float(params.get("l1_ratio", 0.5))}[penalty]
    c = None if penalty == "none" else float(params.get("C", 1.0))
    return L.Spec(tuple(parts), c, ratio, bool(params.get("fit_intercept", True)), True, None if features is None else tuple(features))


# -------------------------------------------------------------- calibration
def smoothed_cells(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells with Platt's targets: a positive counts as (n1 + 1) / (n1 + 2) of one, a negative as 1 / (n0 + 2)."""
    keys = list(keys)
    n = cells.groupBy(*keys).agg(F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0.0)).alias("_n1"), F.sum(F.when(F.col("y") == 0, F.col("w")).otherwise(0.0)).alias("_n0"))
    share = F.when(F.col("y") == 1, (F.col("_n1") + 1) / (F.col("_n1") + 2)).otherwise(1 / (F.col("_n0") + 2))
    both = F.array(F.struct(F.lit(1).alias("y"), (F.col("w") * share).alias("w")), F.struct(F.lit(0).alias("y"), (F.col("w") * (1 - share)).alias("w")))
    return cells.join(n, keys).select(*keys, "p", F.explode(both).alias("_t")).select(*keys, "_t.y", "p", "_t.w")


def sigmoid_params(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, a, b): sigmoid(a + b * logit(p)) fitted to each group's cells with Platt's targets."""
    fitted = M.calibration_fit(smoothed_cells(cells, keys), keys)
    return fitted.select(*keys, F.col("calibration_intercept").alias("a"), F.col("calibration_slope").alias("b"))


def calibrated_mean(scores: DataFrame, params: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, p): the mean over the folds' sigmoids (`params`: a row for each fold) of each score's p."""
    chain = params.agg(F.sort_array(F.collect_list(F.struct("fold_id", "a", "b"))).alias("chain"))  # one row a fold
    clipped = F.least(F.greatest(F.col("p"), F.lit(1e-6)), F.lit(1 - 1e-6))
    logit = F.log(clipped / (1 - clipped))
    total = F.aggregate("chain", F.lit(0.0), lambda s, x: s + 1 / (1 + F.exp(-(x["a"] + x["b"] * logit))))
    return scores.join(F.broadcast(chain), F.lit(True), "left").select(*keys, F.round(total / F.size("chain"), 9).alias("p"))


# ------------------------------------------------------------------- scoring
def composite_scores(cells: DataFrame, policies: Sequence[Policy] = POLICIES, deployment: str = DEPLOYMENT_POLICY, components=SCORE_COMPONENTS) -> DataFrame:
    """(model_name, composite_score, policy_threshold, policy_name) of cells (model_name, y, p, w)."""
    val = M.metric_payload(cells, ["model_name"], 0.5, w="w")
    chosen = P.deployment_row(P.policy_select(cells, ["model_name"], policies, w="w"), ["model_name"], deployment, [p.name for p in policies])
    pol = chosen.select("model_name", "policy_name", *[F.col(m).alias(f"policy_{m}") for m in S.POLICY_METRICS])
    scored = S.composite_score(val, pol, components)
    per_model = scored.groupBy("model_name").agg(F.first("composite_score").alias("composite_score"))
    return per_model.join(pol.select("model_name", "policy_name", "policy_threshold"), "model_name")


def _named(cells: DataFrame, names: Sequence[str], name: str = "model_name") -> DataFrame:
    """Cells with the models' names in place of their numbers (a configured list)."""
    return cells.withColumn(name, F.element_at(F.array(*[F.lit(n) for n in names]), F.col("model") + 1))


@dataclass(frozen=True)
class CrossFitted:
    """Regressions with the sigmoids fitted on what each left out, or one without (and the reason)."""

    fits: tuple[L.Fit, ...]
    chain: tuple[tuple[int, float, float], ...]
    reason: str | None = None


def cross_fit(data: DataFrame, features: Sequence[str], jobs: Mapping[str, tuple[L.Spec, Sequence[Sequence[int]]]]) -> dict[str, CrossFitted]:
    """For each job (a spec, the sets of parts that are held out in turn): its regressions and their sigmoids.

    All jobs are fitted in the same passes. A job without two held-out sets that both have, and leave, each class, is
    fitted once on all its parts, without calibration, with the reason.
    """
    counts = L.class_counts(data)

    def both(parts) -> bool:
        return all(sum(counts.get(p, (0, 0))[k] for p in parts) for k in (0, 1))

    specs: list[L.Spec] = []
    plan: dict[str, tuple[list[int], list[Sequence[int]]]] = {}
    for name, (spec, held) in jobs.items():
        rests = [tuple(p for p in spec.parts if p not in set(h)) for h in held]
        fits_ok = len(held) >= 2 and all(both(h) and both(r) for h, r in zip(held, rests, strict=True))
        sets = rests if fits_ok else [spec.parts]
        plan[name] = (list(range(len(specs), len(specs) + len(sets))), list(held) if fits_ok else [])
        specs += [replace(spec, parts=s) for s in sets]
    fits = L.fit_logistics(data, features, specs)
    held_by = [()] * len(specs)
    for at, held in plan.values():
        for m, h in zip(at, held, strict=False):
            held_by[m] = tuple(h)
    params: dict[int, tuple[float, float]] = {}
    if any(held_by):
        cells = L.score_cells(data, features, fits, held_by).groupBy("model", "y", "p").agg(F.sum("w").alias("w"))
        params = {r.model: (r.a, r.b) for r in sigmoid_params(M.to_cells(cells, ["model"], w="w"), ["model"]).collect()}  # a row a regression
    out = {}
    for name, (at, held) in plan.items():
        chain = tuple((k, *params[m]) for k, m in enumerate(at)) if held else ((0, 0.0, 1.0),)
        out[name] = CrossFitted(tuple(fits[m] for m in at), chain, None if held else "insufficient_class_support_for_calibration")
    return out


def held_out_cells(data: DataFrame, features: Sequence[str], models: Mapping[str, CrossFitted], held: Mapping[str, Sequence[int]]) -> DataFrame:
    """(model_name, part, y, p, w): each model's calibrated probabilities of its held-out parts, counted on the grid of logits."""
    fits: list[L.Fit] = []
    chains, names = [], list(models)
    for m in models.values():
        chains.append([(len(fits) + k, a, b) for k, a, b in m.chain])
        fits += m.fits
    cells = L.score_cells(data, features, fits, [held[n] for n in names], chains=chains)
    return _named(cells, names).select("model_name", "part", "y", "p", "w")


# -------------------------------------------------------------------- search
@dataclass(frozen=True)
class Tuned:
    """The trials with their scores, the best one's parameters, and its model on all folds."""

    trials: DataFrame
    best: dict
    model: CrossFitted
    reason: str | None = None


def search_tune(train: DataFrame, features: Sequence[str], target: str, n_trials: int = N_TRIALS, folds: int = CV_FOLDS, seed: int = 42, space: Mapping[str, Mapping] | None = None,
                transform: Callable[[DataFrame], DataFrame] | None = None) -> Tuned:
    """Trials of the baseline family, scored by the mean composite score of calibrated models over stratified folds.

    The model of (trial, fold) learns from the other folds; its calibration leaves out one of these in turn. Without a
    space, or with fewer than two folds that have every class, the default parameters are fitted directly, with the reason.
    `transform` makes the features from the rows, once these are dealt into folds.
    """
    spark, made = train.sparkSession, transform or (lambda x: x)
    space = SEARCH_SPACES["baseline"] if space is None else space
    reason = None if space else "no_search_space"
    parts: list[int] = []
    if space:
        try:
            data = L.design(made(kfold_stratified(train, target, folds, seed)), features, target, "fold_id")
            parts = sorted(L.class_counts(data))
        except ValueError:
            reason = "insufficient_class_support_for_cv"
    empty = spark.createDataFrame([], "trial int, params string, composite_score double, folds int, rank int")
    if reason:
        data = L.design(made(train).withColumn("part", F.lit(1)), features, target, "part")
        model = cross_fit(data, features, {"direct": (regression({}, [1]), [])})["direct"]
        return Tuned(empty, {}, model, reason)
    trials = params_of(sample_trials(spark, "baseline", space, n_trials, seed).collect())
    # trials that differ by solver only are one regression
    distinct: dict[L.Spec, str] = {}
    for t in sorted(trials):
        distinct.setdefault(regression(trials[t]), str(t))
    jobs = {f"{name}|{o}": (replace(spec, parts=tuple(p for p in parts if p != o)), [[i] for i in parts if i != o]) for spec, name in distinct.items() for o in parts}
    models = cross_fit(data, features, jobs)
    cells = held_out_cells(data, features, models, {k: [int(k.split("|")[1])] for k in models})
    scored = composite_scores(cells.select("model_name", "y", "p", "w"))
    means = {r.name: (r.score, r.folds) for r in scored.groupBy(F.split("model_name", r"\|")[0].alias("name")).agg(F.avg("composite_score").alias("score"), F.count(F.lit(1)).cast("int").alias("folds")).collect()}
    rows = sorted(((t, canonical_params(p), *means[distinct[regression(p)]]) for t, p in trials.items()), key=lambda r: (-r[2], r[0]))
    table = spark.createDataFrame([(*r, k + 1) for k, r in enumerate(rows)], empty.schema)
    best = trials[rows[0][0]]
    final = cross_fit(data, features, {"best": (regression(best, parts), [[i] for i in parts])})["best"]
    return Tuned(table, best, final)


def cv_fold_refits(dev: DataFrame, features: Sequence[str], target: str, families: Mapping[str, Mapping], folds: int = 4, threshold: float = 0.5, costs: Policy = _POLICY,
                   transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Metrics of each family (name, parameters) refitted on the other folds, on each fold, at the deployment threshold."""
    folded = kfold_stratified(dev, target, folds)
    data = L.design(folded if transform is None else transform(folded), features, target, "fold_id")
    parts = sorted(L.class_counts(data))
    jobs = {f"{name}|{o}": (regression(p, [x for x in parts if x != o]), [[i] for i in parts if i != o]) for name, p in families.items() for o in parts}
    models = cross_fit(data, features, jobs)
    cells = held_out_cells(data, features, models, {k: [int(k.rsplit("|", 1)[1])] for k in models})
    cells = cells.select(F.regexp_replace("model_name", r"\|\d+$", "").alias("model_name"), F.col("part").cast("string").alias("fold_id"), "y", "p", "w")
    return M.metric_payload(cells, ["model_name", "fold_id"], threshold, costs.fn_cost, costs.fp_cost, w="w")


# -------------------------------------------------------------------- nested
#: Families of the nested audit: what of the baseline space each may draw.
NESTED_FAMILIES = {"ridge": ["l2__lbfgs"], "sparse": ["l1__saga", "elasticnet__saga"], "free": ["none__lbfgs"]}
QUARTERS = 4


def nested_parts(dev: DataFrame, target: str, outer: int = 3, seed: int = 42) -> DataFrame:
    """Rows with `outer_fold`, `quarter` (stratified within the fold) and part = 4 * outer_fold + quarter - 1."""
    folded = kfold_stratified(dev, target, outer, seed, out_col="outer_fold", purpose="outer")
    within = shared_table(folded, "outer-folds").withColumn("_stratum", F.concat_ws(":", F.col("outer_fold").cast("string"), F.col(target).cast("string")))
    ranked = rank_by_hash(within.withColumn("_h", keyed_md5(seed, "quarter", ROW_ID)), ["_stratum"], "_h", ROW_ID, rank_name="_r")
    return ranked.withColumn("quarter", ((F.col("_r") - 1) % QUARTERS + 1).cast("int")).withColumn("part", (F.col("outer_fold") * QUARTERS + F.col("quarter") - 1).cast("int")).drop("_stratum", "_h", "_r")


def nested_cv_audit(dev: DataFrame, features: Sequence[str], target: str, outer: int = 3, n_trials: int = 15, seed: int = 42, policies: Sequence[Policy] = POLICIES, deployment: str = DEPLOYMENT_POLICY,
                    transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row an outer fold: what was chosen without it, and the metrics on it.

    Within the other folds the first quarter of each is the inner validation set, the rest the inner training set. Each
    family is tuned by folds (quarters) of the training set; the families' best, fitted on it, are compared on the validation set, which
    also gives the policy's threshold; the winner is refitted and cross-fitted on both, and meets the outer fold last.
    """
    spark = dev.sparkSession
    dealt = nested_parts(dev, target, outer, seed)
    data = L.design(dealt if transform is None else transform(dealt), features, target, "part")
    counts = L.class_counts(data)
    outers = sorted({p // QUARTERS for p in counts})

    def parts(o: int, quarters) -> list[int]:
        return [p for p in sorted(counts) if p // QUARTERS != o and p % QUARTERS in quarters]

    drawn = {}
    for family, combos in NESTED_FAMILIES.items():
        space = {**SEARCH_SPACES["baseline"], "solver_penalty_combo": {"type": "categorical", "choices": combos}}
        drawn[family] = params_of(sample_trials(spark, f"nested:{family}", space, n_trials, seed).collect())
    # 1: trials on the quarters of the inner training sets
    jobs, held = {}, {}
    for o in outers:
        for family, trials in drawn.items():
            for t, params in trials.items():
                for j in (1, 2, 3):
                    name = f"{o}|{family}|{t}|{j}"
                    jobs[name], held[name] = (regression(params, parts(o, {1, 2, 3} - {j})), []), parts(o, {j})
    tuned = composite_scores(held_out_cells(data, features, cross_fit(data, features, jobs), held).groupBy("model_name", "y", "p").agg(F.sum("w").alias("w")), policies, deployment)
    tuned = tuned.select(*[F.split("model_name", r"\|")[k].alias(n) for k, n in enumerate(("outer", "family", "trial"))], "composite_score")
    means = tuned.groupBy("outer", "family", "trial").agg(F.avg("composite_score").alias("score")).collect()  # trials x folds x families
    best: dict[tuple[int, str], int] = {}
    for r in sorted(means, key=lambda r: (-r.score, int(r.trial))):
        best.setdefault((int(r.outer), r.family), int(r.trial))
    # 2: the families' best on the inner validation sets
    jobs = {f"{o}|{f}": (regression(drawn[f][t], parts(o, {1, 2, 3})), [parts(o, {j}) for j in (1, 2, 3)]) for (o, f), t in best.items()}
    held = {k: parts(int(k.split("|")[0]), {0}) for k in jobs}
    inner = composite_scores(held_out_cells(data, features, cross_fit(data, features, jobs), held).groupBy("model_name", "y", "p").agg(F.sum("w").alias("w")), policies, deployment)
    winners: dict[int, tuple] = {}
    for r in sorted(inner.collect(), key=lambda r: (-r.composite_score, r.model_name)):
        o, family = r.model_name.split("|")
        winners.setdefault(int(o), (family, r.composite_score, r.policy_name, r.policy_threshold))
    # 3: the winners, refitted on all inner rows, on the outer folds
    jobs = {str(o): (regression(drawn[w[0]][best[o, w[0]]], parts(o, {0, 1, 2, 3})), [parts(o, {j}) for j in range(QUARTERS)]) for o, w in winners.items()}
    own = {str(o): [p for p in counts if p // QUARTERS == o] for o in winners}
    cells = held_out_cells(data, features, cross_fit(data, features, jobs), own).groupBy("model_name", "y", "p").agg(F.sum("w").alias("w"))
    costs = {p.name: p for p in policies}
    out = None
    for o, (family, score, policy, threshold) in sorted(winners.items()):
        pay = M.metric_payload(cells.where(F.col("model_name") == str(o)), ["model_name"], float(threshold), costs[policy].fn_cost, costs[policy].fp_cost, w="w")
        rows_out = sum(sum(counts[p]) for p in own[str(o)])
        row = pay.select(
            F.lit(o).alias("fold_id"), F.lit(sum(sum(c) for c in counts.values()) - rows_out).alias("outer_train_rows"), F.lit(rows_out).alias("outer_test_rows"),
            F.lit(family).alias("selected_model_name"), F.lit(canonical_params(drawn[family][best[o, family]])).alias("selected_params"), F.lit(float(score)).alias("selection_score"),
            F.lit(policy).alias("selected_policy_name"), F.lit(float(threshold)).alias("selected_policy_threshold"), F.lit(len(features)).alias("selected_feature_count"),
            F.lit(n_trials * len(drawn)).alias("trials_evaluated"), *[c for c in pay.columns if c not in ("model_name", "threshold")])
        out = row if out is None else out.unionByName(row)
    return out
