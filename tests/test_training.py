"""Regressions in shared passes, search, calibration, nested audit, refits and saved pipelines."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.config import CATEGORY_ORDERS, FIXED_SCORER, RAW_NUMERICAL, TARGET
from riskloom.operators import logistic as L
from riskloom.plans import fitted as FT
from riskloom.plans import search as SE
from riskloom.plans.pipeline import split_cohort
from tests.conftest import SF_SMALL

FEATURES = ["u", "v", "w"]


def planted(spark, n=1200, seed=3, folds=4):
    """Two informative features and one without meaning; part = fold."""
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, 3))
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.4 + 1.5 * x[:, 0] - x[:, 1])))).astype(int)
    rows = [(i, i % folds + 1, int(y[i]), *map(float, x[i])) for i in range(n)]
    return spark.createDataFrame(rows, f"row_id long, fold_id int, {TARGET} int, u double, v double, w double"), x, y, np.arange(n) % folds + 1


def objective(spec, fit, x, y, rows):
    b = np.array([dict(fit.weights).get(f, 0.0) for f in FEATURES])
    z = fit.intercept + x[rows] @ b
    n = np.bincount(y[rows], minlength=2)
    w = (len(rows) / 2 / n)[y[rows]] if spec.balanced else np.ones(len(rows))
    pen = 0 if spec.c is None else (spec.l1_ratio * np.abs(b).sum() + (1 - spec.l1_ratio) / 2 * (b @ b)) / spec.c
    return (w * (np.logaddexp(0, z) - y[rows] * z)).sum() + pen


def test_regressions_reach_their_optimum(spark):
    df, x, y, part = planted(spark)
    data = L.design(df, FEATURES, TARGET, "fold_id")
    specs = [
        L.Spec((1, 2, 3, 4)), L.Spec((1, 2), 0.01), L.Spec((2, 3, 4), None, balanced=False), L.Spec((1, 3), 0.02, 1.0), L.Spec((1, 2, 4), 0.05, 0.5, fit_intercept=False),
        L.Spec((1, 2, 3), 1.0, features=("v",)), L.Spec((9,)),
    ]
    fits = L.fit_logistics(data, FEATURES, specs)
    assert all(f.converged for f in fits)
    rng = np.random.default_rng(0)
    for spec, fit in zip(specs[:-1], fits, strict=False):
        rows = np.flatnonzero(np.isin(part, spec.parts))
        best = objective(spec, fit, x, y, rows)
        free = [i for i, f in enumerate(FEATURES) if spec.features is None or f in spec.features]
        for scale in (1e-1, 1e-3):
            for _ in range(40):  # no neighbour is better
                move = np.zeros(3)
                move[free] = rng.normal(0, scale, len(free))
                other = L.Fit(fit.intercept + (rng.normal(0, scale) if spec.fit_intercept else 0), tuple((f, dict(fit.weights).get(f, 0.0) + m) for f, m in zip(FEATURES, move, strict=True)), 0, True)
                assert objective(spec, other, x, y, rows) >= best - 1e-9 * abs(best)
    assert fits[4].intercept == 0 and dict(fits[3].weights)["w"] == 0.0 and set(dict(fits[5].weights)) == {"v"}
    assert fits[6].weights == () and fits[6].intercept == 0.0  # no rows


def test_one_class_is_a_constant(spark):
    df = spark.createDataFrame([(i, 1, 1, 1.0, 2.0, None) for i in range(9)], f"row_id long, fold_id int, {TARGET} int, u double, v double, w double")
    fit = L.fit_logistics(L.design(df, FEATURES, TARGET, "fold_id"), FEATURES, [L.Spec((1,))])[0]
    assert fit.weights == () and fit.intercept == pytest.approx(np.log(9.5 / 0.5))


def test_score_cells_are_the_held_out_rows(spark):
    df, x, y, part = planted(spark)
    data = L.design(df, FEATURES, TARGET, "fold_id")
    fits = L.fit_logistics(data, FEATURES, [L.Spec((1, 2, 3)), L.Spec((4,))])
    cells = L.score_cells(data, FEATURES, fits, [[4], [1, 2]]).toPandas()
    assert cells.groupby(["model", "part"]).w.sum().to_dict() == {(0, 4): 300, (1, 1): 300, (1, 2): 300}
    own = cells[cells.model == 0]
    p = 1 / (1 + np.exp(-(fits[0].intercept + x[part == 4] @ np.array([w for _, w in fits[0].weights]))))
    assert own[own.y == 1].w.sum() == y[part == 4].sum() and (own.p * own.w).sum() == pytest.approx(p.sum(), abs=0.5)
    chained = L.score_cells(data, FEATURES, fits, [[4]], chains=[[(0, 0.2, 1.5), (1, -0.1, 0.7)]]).toPandas()
    z = [f.intercept + x[part == 4] @ np.array([w for _, w in f.weights]) for f in fits]
    mean = (1 / (1 + np.exp(-(0.2 + 1.5 * z[0]))) + 1 / (1 + np.exp(-(-0.1 + 0.7 * z[1])))) / 2
    assert (chained.p * chained.w).sum() == pytest.approx(mean.sum(), abs=0.5)


# ------------------------------------------------------------------- sampler
def test_trials_do_not_depend_on_order_or_number(spark):
    space = SE.SEARCH_SPACES["xgboost"]
    few = {tuple(r) for r in SE.sample_trials(spark, "xgboost", space, 5).collect()}
    more = {tuple(r) for r in SE.sample_trials(spark, "xgboost", dict(reversed(space.items())), 60).collect()}
    assert few < more and len(more) == 60 * len(space)
    for name, c in space.items():
        values = [r[3] for r in more if r[2] == name]
        assert min(values) >= c["low"] and max(values) <= c["high"] and len(set(values)) > 5
        assert c["type"] != "int" or all(v == int(v) for v in values)


def test_active_and_conditional_parameters(spark):
    trials = SE.params_of(SE.sample_trials(spark, "baseline", SE.SEARCH_SPACES["baseline"], 200).collect())
    for p in trials.values():
        penalty = p["solver_penalty_combo"].split("__")[0]
        assert ("C" in p) == (penalty != "none") and ("l1_ratio" in p) == (penalty == "elasticnet") and isinstance(p["fit_intercept"], bool)
    assert len({p["solver_penalty_combo"] for p in trials.values()}) == 10
    space = {"kind": {"type": "categorical", "choices": ["tree", None]}, "depth": {"type": "conditional_categorical", "parent": "kind", "choices_by_parent": {"tree": [1, 2], "null": ["none"]}},
             "leaf": {"type": "int", "low": 1, "high": 3, "active_if": {"kind": ["tree"]}}}
    drawn = SE.params_of(SE.sample_trials(spark, "x", space, 40).collect())
    assert {(p["kind"], p["depth"]) for p in drawn.values()} == {("tree", "1"), ("tree", "2"), (None, "none")}
    assert all(("leaf" in p) == (p["kind"] == "tree") for p in drawn.values())
    with pytest.raises(ValueError):
        SE.sample_trials(spark, "x", {"a": {"type": "what"}}, 2)
    with pytest.raises(ValueError):
        SE.sample_trials(spark, "x", {"kind": space["kind"], "d": {"type": "conditional_categorical", "parent": "kind", "choices_by_parent": {"tree": []}}}, 2)


def test_canonical_params():
    assert SE.canonical_params({"b": 1, "a": {"y": 2, "x": [1, True]}}) == SE.canonical_params({"a": {"x": [1.0, True], "y": 2.0}}, {"b": 1})
    assert SE.canonical_params({"a": 1}) != SE.canonical_params({"a": True})


# -------------------------------------------------------------------- search
def test_search_finds_the_planted_signal(spark):
    df, *_ = planted(spark)
    tuned = SE.search_tune(df, FEATURES, TARGET, n_trials=8, folds=3)
    rows = tuned.trials.orderBy("rank").collect()
    assert len(rows) == 8 and [r.rank for r in rows] == list(range(1, 9)) and {r.folds for r in rows} == {3}
    assert all(a.composite_score >= b.composite_score for a, b in zip(rows, rows[1:], strict=False))
    assert json.loads(rows[0].params) == json.loads(SE.canonical_params(tuned.best))
    assert len(tuned.model.fits) == 3 and tuned.model.reason is None
    weights = dict(tuned.model.fits[0].weights)
    assert weights["u"] > 0.5 > abs(weights["w"]) and weights["v"] < -0.3


def test_search_falls_back_to_a_direct_fit(spark):
    df, *_ = planted(spark)
    assert SE.search_tune(df, FEATURES, TARGET, space={}).reason == "no_search_space"
    rare = df.where(F.col(TARGET) == 0).unionByName(df.where(F.col(TARGET) == 1).limit(1))
    tuned = SE.search_tune(rare, FEATURES, TARGET, n_trials=3)
    assert tuned.reason == "insufficient_class_support_for_cv" and tuned.trials.count() == 0 and tuned.model.reason == "insufficient_class_support_for_calibration"


def test_cross_fit_calibrates(spark):
    df, x, y, part = planted(spark, 4000)
    data = L.design(df.withColumn("part", F.when(F.col("row_id") >= 3000, 0).otherwise(F.col("fold_id"))), FEATURES, TARGET, "part")
    jobs = {"cal": (L.Spec((1, 2, 3, 4), balanced=True), [[1], [2], [3], [4]]), "one": (L.Spec((1, 2)), [[1, 2]])}
    models = SE.cross_fit(data, FEATURES, jobs)
    assert len(models["cal"].fits) == 4 and len(models["cal"].chain) == 4 and models["one"].reason == "insufficient_class_support_for_calibration"
    # each regression is the one of the other parts
    alone = L.fit_logistics(data, FEATURES, [L.Spec((2, 3, 4))])[0]
    assert dict(models["cal"].fits[0].weights) == pytest.approx(dict(alone.weights))
    cells = SE.held_out_cells(data, FEATURES, models, {"cal": [0], "one": [0]}).toPandas()
    own = cells[cells.model_name == "cal"]
    assert own.w.sum() == 1000 and (own.p * own.w).sum() == pytest.approx(y[3000:].sum(), rel=0.1)


def test_fold_refits_beat_a_constant(spark):
    df, *_ = planted(spark)
    got = SE.cv_fold_refits(df.drop("fold_id"), FEATURES, TARGET, {"a": {"C": 1.0}, "b": {"solver_penalty_combo": "l1__saga", "C": 1e-4}}, folds=3).collect()
    assert len(got) == 6
    assert all(r.roc_auc > 0.75 and r.brier < 0.2 for r in got if r.model_name == "a")
    assert all(r.roc_auc == pytest.approx(0.5) for r in got if r.model_name == "b")  # everything penalised away


def test_nested_audit_never_learns_from_its_outer_fold(spark, monkeypatch):
    df, *_ = planted(spark, 900)
    seen = []
    real = SE.cross_fit

    def spy(data, features, jobs):
        seen.append({k: (set(s.parts), [set(h) for h in held]) for k, (s, held) in jobs.items()})
        return real(data, features, jobs)

    monkeypatch.setattr(SE, "cross_fit", spy)
    rows = SE.nested_cv_audit(df.drop("fold_id"), FEATURES, TARGET, n_trials=2).orderBy("fold_id").collect()
    assert [r.fold_id for r in rows] == [1, 2, 3] and sum(r.outer_test_rows for r in rows) == 900 and all(r.outer_train_rows + r.outer_test_rows == 900 for r in rows)
    assert all(r.roc_auc > 0.7 and r.selected_model_name in SE.NESTED_FAMILIES and r.trials_evaluated == 6 for r in rows)
    assert len(seen) == 3
    for jobs in seen:
        for name, (parts, held) in jobs.items():
            outer = int(name.split("|")[0])
            used = parts.union(*held) if held else parts
            assert used and all(p // SE.QUARTERS != outer for p in used)
    # quarters that tune or validate are in no set that is fitted before them
    for name, (parts, _) in seen[0].items():
        assert all(p % SE.QUARTERS not in (0, int(name.split("|")[3])) for p in parts)
    for parts, _ in seen[1].values():
        assert all(p % SE.QUARTERS != 0 for p in parts)


# ----------------------------------------------------------- refit, save, load
@pytest.fixture(scope="module")
def cohort_rows(spark):
    return split_cohort(spark, SF_SMALL).cache()


def scores(fitted, rows):
    return {r.row_id: (r.prediction_proba, r.prediction, r.risk_band) for r in fitted.score(rows).select("row_id", "prediction_proba", "prediction", "risk_band").collect()}


@pytest.mark.parametrize("imputer", ["median", "knn"])
def test_saved_pipeline_scores_alike_in_a_new_session(spark, tmp_path, cohort_rows, imputer):
    fitted = FT.fit_preparation(cohort_rows, ("train",), imputer)
    features = fitted.features()
    data = L.design(fitted.transform(cohort_rows).withColumn("part", F.pmod("row_id", F.lit(3)).cast("int")), features, TARGET, "part")
    model = SE.cross_fit(data, features, {"m": (L.Spec((0, 1, 2)), [[0], [1], [2]])})["m"]
    served = fitted.with_model(model, "m", 0.3, "prioritize_recall")
    FT.save(FT.FittedPipeline(encoded=False), spark, str(tmp_path))
    version = FT.save(served, spark, str(tmp_path))
    loaded = FT.load(spark.newSession(), str(tmp_path))
    assert FT.versions(spark, str(tmp_path)).head().version == version and FT.versions(spark, str(tmp_path)).count() == 2
    assert (loaded.caps, loaded.categories, loaded.scales, loaded.models, loaded.threshold, loaded.policy) == (served.caps, served.categories, served.scales, served.models, 0.3, "prioritize_recall")
    test = cohort_rows.where("split = 'test'")
    before, after = scores(served, test), scores(loaded, test)
    assert before == after and len({p for p, *_ in before.values()}) > 50
    shown = loaded.score(test).columns
    assert set(CATEGORY_ORDERS) <= set(shown) and set(RAW_NUMERICAL) <= set(shown)


def test_unpublished_versions_are_not_seen(spark, tmp_path):
    pipeline = FT.FittedPipeline(encoded=False)
    first = FT.save(pipeline, spark, str(tmp_path))
    pipeline.parameters(spark).write.parquet(f"{tmp_path}/versions/half/parameters")  # a writer that failed before it published
    assert [r.version for r in FT.versions(spark, str(tmp_path)).collect()] == [first]
    assert FT.load(spark, str(tmp_path)).models == ((FIXED_SCORER, 0.0, 1.0),)
    with pytest.raises(LookupError):
        FT.load(spark, str(tmp_path), "half")


def test_refit_on_all_splits_is_the_fit_of_their_union(spark, cohort_rows):
    whole = FT.fit_preparation(cohort_rows, None)
    union = FT.fit_preparation(cohort_rows.withColumn("split", F.lit("all")), ("all",))
    train = FT.fit_preparation(cohort_rows, ("train",))
    assert (whole.medians, whole.caps, whole.categories) == (union.medians, union.caps, union.categories)
    assert whole.scales == {k: pytest.approx(v) for k, v in union.scales.items()}
    assert whole.scales != train.scales and whole.fit_splits is None
    with pytest.raises(ValueError):
        FT.fit_preparation(cohort_rows, None, "mode")


def test_design_writes_a_column_for_each_feature(spark):
    rows = [(i % 3, i % 2, float(i % 5), None if i % 7 == 0 else float("nan") if i % 7 == 1 else i / 10) for i in range(60)]
    df = spark.createDataFrame([*rows, (None, 1, 1.0, 1.0), (1, None, 1.0, 1.0), (1, 2, 1.0, 1.0)], "fold int, t int, a double, b double")
    data = L.design(df, ["a", "b"], "t", "fold")
    assert [(c, t) for c, t in data.dtypes] == [("part", "int"), ("y", "int"), ("x", "array<double>")]
    assert sorted((r.part, r.y, *r.x) for r in data.collect()) == sorted((f, t, a, 0.0 if b is None or b != b else b) for f, t, a, b in rows)
    (folder,) = {os.path.dirname(f) for f in data.inputFiles()}
    assert spark.read.parquet(folder).columns == ["part", "y", "x0", "x1"]


def test_equal_specs_are_fitted_once_and_collinear_l1_models_end(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 3))
    x[:, 2] = x[:, 0] + x[:, 1] + 1e-3 * rng.normal(size=900)
    y = rng.random(900) < 1 / (1 + np.exp(-(x[:, 0] - 0.5 * x[:, 1])))
    df = spark.createDataFrame([(i % 3 + 1, int(t), *map(float, v)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "f int, t int, u double, v double, w double")
    data = L.design(df, FEATURES, "t", "f")
    passed = []
    real = L._pass
    monkeypatch.setattr(L, "_pass", lambda table, beta, *a, **k: (passed.append(beta.shape[1]), real(table, beta, *a, **k))[1])
    # a fold left out by the model and one by its calibration, in either order
    jobs = {str(o): (L.Spec(tuple(p for p in (1, 2, 3) if p != o), 150.0, 1.0), [[i] for i in (1, 2, 3) if i != o]) for o in (1, 2, 3)}
    models = SE.cross_fit(data, FEATURES, jobs)
    assert max(passed) == 3 and len(passed) < 15
    assert all(len(m.fits) == 2 and all(f.converged for f in m.fits) for m in models.values())
    assert models["1"].fits[0] == models["2"].fits[0] and models["1"].chain[0][1:] != models["2"].chain[0][1:]


@pytest.mark.parametrize("seed", range(6))
def test_exact_step_has_no_better_neighbour(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(50, 6))
    h, g, b, l1 = x.T @ x, rng.normal(0, 40, 6), rng.normal(size=6) * (rng.random(6) < 0.5), np.append(0.0, rng.exponential(20, 5))
    value = lambda d: g @ d + d @ h @ d / 2 + l1 @ np.abs(b + d)
    d = L.exact_step(b, g, h, l1, np.zeros(6))
    assert all(value(d + rng.normal(0, s, 6) * (rng.random(6) < 0.5)) >= value(d) - 1e-9 * abs(value(d)) for s in (1, 1e-2, 1e-4) for _ in range(200))
