import pytest
from pyspark.sql import functions as F

from riskloom.config import BMI_BINS, BMI_LABELS, RAW_ROLES
from riskloom.functions import expressions as X
from riskloom.operators import quality as Q


def test_bin_cut_right_closed_lowest_included(spark):
    df = spark.createDataFrame([(0.0,), (18.5,), (18.51,), (29.9,), (30.0,), (None,), (-1.0,)], "v double")
    got = [r[0] for r in df.select(X.bin_cut("v", BMI_BINS, BMI_LABELS)).collect()]
    assert got == ["underweight", "underweight", "healthy", "overweight", "obese", "nan", "nan"]


def test_clip_keeps_missing(spark):
    df = spark.createDataFrame([(None,), (5.0,), (-3.0,)], "v double")
    assert [r[0] for r in df.select(X.clip_null_safe("v", 0.0, 4.0)).collect()] == [None, 4.0, 0.0]


def test_clean_coerce(spark):
    df = spark.createDataFrame([(" 2 ",), ("abc",), ("NaN",), ("",), (None,), ("inf",)], "v string")
    got = [r[0] for r in df.select(X.clean_coerce("v")).collect()]
    assert got[:5] == [2.0, 0.0, 0.0, 0.0, 0.0] and got[5] == float("inf")


def test_cascade_band_missing_is_high(spark):
    df = spark.createDataFrame([(60.0,), (70.0,), (100.0,), (125.0,), (125.5,), (None,)], "v double")
    assert [r[0] for r in df.select(X.cascade_band("v", 70, 100, 125)).collect()] == ["low", "normal", "hidden", "hidden", "high", "high"]


def test_component_utility(spark):
    df = spark.createDataFrame([("brier", 0.2, "minimize"), ("log_loss", 1.0, "minimize"), ("recall", None, "maximize")],
                               "m string, v double, d string")
    got = [r[0] for r in df.select(X.component_utility(F.col("m"), F.col("v"), F.col("d"))).collect()]
    assert got == pytest.approx([0.8, 0.5, 0.5])


def test_validate_clean_raises_on_critical(spark):
    df = spark.createDataFrame([(float(i), i % 2) for i in range(5)], "Glucose double, Outcome int")
    with pytest.raises(Q.ExpectationFailed):
        Q.validate_clean(df, RAW_ROLES, raise_on_critical=True)  # too few rows + missing columns


def test_psi_drift_label(spark):
    rows = [("train", float(v)) for v in (80, 90, 100, 110)] + [("validation", float(v)) for v in (180, 190, 200, 210)] + \
           [("test", float(v)) for v in (81, 91, 99, 111)]
    df = spark.createDataFrame(rows, "split string, Glucose double")
    out = {r["comparison_split"]: r for r in Q.drift_psi(df, ["Glucose"], bins=5).collect()}
    assert out["validation"]["drift_label"] == "drift" and out["test"]["drift_label"] == "stable"
