"""md5 of many texts at a time against hashlib, and what is moved for resamples."""

import hashlib

import numpy as np
import pyarrow as pa

from riskloom.functions.md5_rows import Texts, gathered
from riskloom.operators import robustness as R


def test_first_bytes_are_those_of_hashlib():
    texts = [b"", b"7", b"None", "é".encode(), *[str(k).encode() for k in (-3, 10**18, *range(95, 120))], b"x" * 52, b"y" * 80, b"7"]
    some = Texts(texts)
    for prefix in (b"", b"a", b"42:boot:7:", b"42:boot:77:", b"42:boot:777:", b"p" * 56):
        assert some.first8(prefix).tolist() == [int.from_bytes(hashlib.md5(prefix + t).digest()[:8], "big") for t in texts]
    assert Texts([]).first8(b"a").tolist() == []


def test_weights_are_the_inverse_of_the_draws():
    keys = [*range(400), None, "k"]
    draws = [[int.from_bytes(hashlib.md5(f"5:boot:{i}:{k}".encode()).digest()[:6], "big") for i in range(1, 31)] for k in keys]
    assert (R.poisson_weights(keys, 30, 5) == np.searchsorted(np.array(R.POISSON1_CDF) * 2.0**48, draws, "right")).all()


def test_gathered_batches_keep_their_rows():
    batches = [pa.RecordBatch.from_pydict({"a": list(range(i, i + 3))}) for i in range(0, 21, 3)]
    out = list(gathered(iter(batches), 7))
    assert [b.num_rows for b in out] == [9, 9, 3] and [x for b in out for x in b.column("a").to_pylist()] == list(range(21))


def test_weights_are_not_moved(spark):
    scores = spark.createDataFrame([("m", i, i % 2, i / 100) for i in range(100)], "model_name string, row_id long, y int, p double")
    plan = R.bootstrap_metrics(scores, 3, 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.index("MapInArrow") < plan.index("RepartitionByExpression")


def test_a_row_without_a_score_counts_as_in_the_payload(spark):
    rows = [("m", i, i % 2, None if i in (4, 7) else (i + 1) / 40) for i in range(30)]
    scores = spark.createDataFrame(rows, "model_name string, row_id long, y int, p double")
    weights = R.poisson_weights(range(30), 1)[:, 0]
    again = [r for r, w in zip(rows, weights, strict=True) for _ in range(w)]
    want = R.M.metric_payload(spark.createDataFrame(again, scores.schema), ["model_name"], 0.4, 8.0, 1.0).head()
    got = R.bootstrap_metrics(scores, 1, 0.4, 8.0, 1.0).head()
    assert weights[4] + weights[7] > 0
    for c in R.BOOTSTRAP_METRICS:
        assert abs(got[c] - want[c]) < 1e-6, c
