"""Permuted values against a plain sort, and the lots that importances are taken in."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.config import LinearScorer
from riskloom.operators import robustness as R


def planted(spark, n=700):
    rng = np.random.default_rng(4)
    rows = [(None if i == 13 else 1000 + 7 * i, int(rng.random() < 0.4), None if i % 50 == 3 else round(float(rng.normal()), 1), float(rng.normal())) for i in range(n)]
    return rows, spark.createDataFrame(rows, "row_id long, Outcome int, a double, b double").repartition(5)


@pytest.mark.parametrize("ranks", [37, 1 << 17])
def test_permuted_values_are_those_of_the_same_rank(spark, monkeypatch, ranks):
    monkeypatch.setattr(R, "PERMUTATION_RANKS", ranks)
    rows, df = planted(spark)
    got = R.permuted_table(df, ["a", "b"], 3).collect()
    assert len(got) == 6 * len(rows) and set(got[0].asDict()) == {"feature_name", "repeat", "row_id", "Outcome", "a", "b", "permuted_value"}
    order = lambda name, f, r: sorted(rows, key=lambda x: hashlib.md5(f"42:{name}:{f}:{r}{'' if x[0] is None else f':{x[0]}'}".encode()).hexdigest())
    for i, f in ((2, "a"), (3, "b")):
        for r in (1, 2, 3):
            expected = {x[0]: (x[1:], y[i]) for x, y in zip(order("perm_a", f, r), order("perm_b", f, r), strict=True)}
            assert {x.row_id: ((x.Outcome, x.a, x.b), x.permuted_value) for x in got if (x.feature_name, x.repeat) == (f, r)} == expected
    assert R.permuted_table(df.limit(0), ["a", "b"], 2).count() == 0


def test_importances_are_taken_in_lots_and_nothing_is_kept(spark, monkeypatch):
    _, df = planted(spark)
    scorer = LinearScorer(-0.2, (("a", 1.5), ("b", -0.7)), "m", 6)
    lots = []
    real = R.permuted_table
    monkeypatch.setattr(R, "permuted_table", lambda *a, **k: (lots.append(list(k["only"])), real(*a, **k))[1])
    whole = R.permutation_importance(df, scorer, 5, 0.4).orderBy("feature_name", "metric_name").collect()
    monkeypatch.setattr(R, "PERMUTED_AT_ONCE", 2 * 2 * df.count())
    assert R.permutation_importance(df, scorer, 5, 0.4).orderBy("feature_name", "metric_name").collect() == whole
    assert lots == [[1, 2, 3, 4, 5], [1, 2], [3, 4], [5]] and {x.repeats for x in whole} == {5}
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()
    # against scores of the permuted rows
    perm = real(df, ["a", "b"], 5).where(F.col("feature_name") == "a").toPandas()
    z = -0.2 + 1.5 * perm.permuted_value - 0.7 * perm.b
    # a score that is null counts as the least probability
    p, y = (1 / (1 + np.exp(-z))).round(6).fillna(1e-6), perm.Outcome
    base = df.toPandas()
    q = (1 / (1 + np.exp(-(-0.2 + 1.5 * base.a - 0.7 * base.b)))).round(6).fillna(1e-6)
    change = ((p - y) ** 2).groupby(perm.repeat).sum() / len(base) - ((q - base.Outcome) ** 2).sum() / len(base)
    got = next(x for x in whole if (x.feature_name, x.metric_name) == ("a", "brier"))
    assert got.importance_mean == pytest.approx(change.mean(), abs=1e-7) and got.importance_std == pytest.approx(change.std(), abs=1e-7)
