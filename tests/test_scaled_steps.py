"""Steps that had to grow no faster than their rows: what is shared, and that it gives what the plain way gives."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.functions.hashing import keyed_md5
from riskloom.operators import feature_select as FS
from riskloom.operators import logistic as L
from riskloom.operators import metrics as M
from riskloom.operators.quantiles import exact_quantiles
from riskloom.operators.split import split_stratified
from riskloom.plans import pipeline as PL
from riskloom.plans import queries as Q
from tests.conftest import SF_SMALL


@pytest.fixture
def scans(monkeypatch):
    """How often the cohort is derived from its table."""
    made = []
    real = PL.cohort
    monkeypatch.setattr(PL, "cohort", lambda *a, **k: (made.append(1), real(*a, **k))[1])
    return made


@pytest.mark.parametrize("name", ["predict", "score_request", "artifact_save_load", "candidate_cv"])
def test_a_query_splits_the_cohort_once_and_reads_the_table(spark, scans, monkeypatch, name):
    if name == "candidate_cv":
        monkeypatch.setattr(FS, "candidate_cv_linear", lambda df, *a, **k: df)
        monkeypatch.setattr(FS, "enumerate_candidates", lambda *a, **k: [])
        monkeypatch.setattr(FS, "candidates_frame", lambda *a: None)
    df = Q.QUERIES[name](spark, SF_SMALL)
    assert len(scans) == 1
    assert df.inputFiles() and not any("lineitem" in f for f in df.inputFiles())


def test_the_split_is_that_of_ranks_with_repeated_and_null_keys(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 50 != 0, F.col("id") % 3000).alias("row_id"), F.when(F.col("id") % 7 != 0, F.col("id") % 2).alias("g"), "id")
    got = split_stratified(rows, "g")
    w = Window.partitionBy("g")
    rank = F.row_number().over(w.orderBy(keyed_md5(42, "split", "row_id"), "row_id"))
    part = rows.select("*", rank.alias("r"), F.count(F.lit(1)).over(w).alias("n"))
    want = part.withColumn("split", F.when(F.col("r") <= F.floor(F.col("n") * 0.7), "train").when(F.col("r") <= F.floor(F.col("n") * 0.85), "validation").otherwise("test"))
    count = lambda d: sorted((str(r["g"]), r["split"], r["count"]) for r in d.groupBy("g", "split").count().collect())
    assert count(got) == count(want)
    single = rows.where("row_id is not null").dropDuplicates(["row_id"]).select("row_id", "g").localCheckpoint()
    ranked = single.select("*", rank.alias("r"), F.count(F.lit(1)).over(w).alias("n"))
    want = {r.row_id: "train" if r.r <= int(r.n * 0.7) else "validation" if r.r <= int(r.n * 0.85) else "test" for r in ranked.collect()}
    assert {r.row_id: r.split for r in split_stratified(single, "g").collect()} == want
    # rows stay where they are, but for the few in a bucket that a limit falls into
    plan = split_stratified(single, "g")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and "isnull(_rl_label" in plan.replace(" ", "").lower()


def test_quantiles_keep_nothing_and_match_numpy(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=3000) * 1e6, np.repeat(2.5, 500), [1e308, -1e308]])
    df = spark.createDataFrame([(float(v), None if i % 3 else float(i)) for i, v in enumerate(values)], "a double, b double")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 1.0]
    got = exact_quantiles(df, ["a", "b"], probs)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    assert np.allclose(got["a"], np.quantile(values, probs), rtol=1e-12)
    assert np.allclose(got["b"], np.quantile(np.arange(0, len(values), 3.0), probs), rtol=1e-12)


def test_metrics_of_counts_are_those_of_rows(spark):
    rng = np.random.default_rng(5)
    p = np.round(rng.random(2000), 2)
    y = (rng.random(2000) < 0.2 + 0.6 * p).astype(int)
    df = spark.createDataFrame([(1, int(b), float(a)) for a, b in zip(p, y, strict=True)], "k int, y int, p double")
    want = M.probability_metrics(M.to_cells(df, ["k"]), ["k"]).head()
    at = np.unique(p)
    got = M.metrics_of_counts(at, *[np.array([((p == x) & (y == c)).sum() for x in at]) for c in (0, 1)])
    assert {k: pytest.approx(want[k], abs=2e-7) for k in got} == got
    pay = M.metric_payload(df, ["k"], 0.5).head()
    assert pay["roc_auc"] == want["roc_auc"] and pay["brier"] == pytest.approx(want["brier"], abs=1e-9) and pay["tp"] == int(((p >= 0.5) & (y == 1)).sum())


def test_candidates_send_a_row_for_each_fold_and_candidate(spark, monkeypatch):
    """What a task sends doesn't grow with its batches."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6000, 3))
    rows = [(i % 3 + 1, int(rng.random() < 1 / (1 + np.exp(-v[0] - 0.5 * v[1]))), *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "fold_id int, t int, a double, b double, c double").coalesce(1)
    cands = FS.enumerate_candidates({"a": ["a"], "b": ["b"], "c": ["c"]})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    sent = []
    real = FS._blocks_of
    monkeypatch.setattr(FS, "_blocks_of", lambda *a: (lambda d: (sent.append(d.count()), d)[1])(real(*a)))
    try:
        out = FS.candidate_cv_linear(df, cands, ["a", "b", "c"], "t").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(out) == 3 * len(cands) and sent == [3, 3 * len(cands)]
    # against a direct fit of one candidate without one fold
    folds, t = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    design = np.column_stack([np.ones(len(x)), x[:, :2]])
    beta = np.linalg.lstsq(design[folds != 2], t[folds != 2], rcond=None)[0]
    p = np.clip(design[folds == 2] @ beta, 1e-6, 1 - 1e-6)
    own = next(c["candidate_id"] for c in cands if c["features"] == ["a", "b"])
    got = next(r for r in out if r["candidate_id"] == own and r["fold_id"] == 2)
    assert got["brier"] == pytest.approx(((p - t[folds == 2]) ** 2).mean(), abs=1e-4)


def test_regressions_with_sampled_hessians_have_the_same_optima(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(6000, 4))
    x[:, 3] = rng.random(6000) < 0.02  # a column that few rows of a sample have
    y = rng.random(6000) < 1 / (1 + np.exp(-(0.5 + x @ [1.0, -0.7, 0.0, 2.0])))
    df = spark.createDataFrame([(i % 3 + 1, int(t), *map(float, v)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "f int, y int, a double, b double, c double, d double")
    names = list("abcd")
    data = L.design(df, names, "y", "f")
    specs = [L.Spec((1, 2, 3)), L.Spec((1, 2), c=0.05, l1_ratio=1.0), L.Spec((2, 3), c=None), L.Spec((1, 3), c=0.5, l1_ratio=0.5, fit_intercept=False)]
    want = L.fit_logistics(data, names, specs)
    hessians = []
    real = L._pass

    def spy(table, beta, member, weight, hessian=True, scale=None):
        if hessian and scale is None and len(table.inputFiles()) and "design" in table.inputFiles()[0]:
            hessians.append(beta.shape[1])
        return real(table, beta, member, weight, hessian, scale)

    monkeypatch.setattr(L, "HESSIAN_ROWS", 1500)
    monkeypatch.setattr(L, "_pass", spy)
    got = L.fit_logistics(data, names, specs)
    for a, b in zip(got, want, strict=True):
        assert a.converged and a.intercept == pytest.approx(b.intercept, abs=2e-5)
        assert dict(a.weights) == {k: pytest.approx(v, abs=2e-5) for k, v in b.weights}
    assert sum(hessians) < sum(f.rounds for f in want)
