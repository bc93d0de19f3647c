import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.functions.hashing import keyed_md5
from riskloom.operators.quantiles import exact_quantiles
from riskloom.operators.ranking import global_rank, rank_by_hash
from riskloom.sources.cohort import cohort
from tests.conftest import SF_SMALL


def test_rank_by_hash_equals_window(spark):
    c = cohort(spark, SF_SMALL).withColumn("h", keyed_md5(42, "split", "row_id"))
    ours = rank_by_hash(c, ["Outcome"], "h", "row_id", rank_name="r", digits=2).select("row_id", "r")
    ref = c.select("row_id", F.row_number().over(Window.partitionBy("Outcome").orderBy("h", "row_id")).alias("r"))
    assert ours.exceptAll(ref).count() == 0 and ref.exceptAll(ours).count() == 0


def test_rank_partition_invariant(spark):
    c = cohort(spark, SF_SMALL).withColumn("h", keyed_md5(42, "split", "row_id"))
    a = rank_by_hash(c.repartition(1), ["Outcome"], "h", "row_id", rank_name="r").select("row_id", "r")
    b = rank_by_hash(c.repartition(13), ["Outcome"], "h", "row_id", rank_name="r").select("row_id", "r")
    assert a.exceptAll(b).count() == 0


def test_global_rank_with_hot_ties(spark):
    # a third of rows share one value: ties split by row_id across ranges
    df = spark.range(0, 3000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.col("id") / 3000.0).alias("p"))
    ours = global_rank(df, [F.col("p").desc(), F.col("row_id")], rank_name="r", num_ranges=7).select("row_id", "r")
    ref = df.select("row_id", F.row_number().over(Window.orderBy(F.col("p").desc(), "row_id")).alias("r"))
    assert ours.exceptAll(ref).count() == 0


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(0)
    vals = np.concatenate([rng.normal(size=5000), np.full(3000, 1.25), rng.exponential(size=2000)])
    rows = [(float(v),) for v in vals] + [(None,), (float("nan"),)]
    df = spark.createDataFrame(rows, "v double")
    probs = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    got = exact_quantiles(df, ["v"], probs, buckets=64)["v"]
    want = np.quantile(vals, probs)
    assert np.allclose(got, want, rtol=0, atol=1e-12)


def test_exact_quantiles_empty(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert exact_quantiles(df, ["v"], [0.5])["v"] == [None]
