"""Stand-in clinical cohort derived from ``lineitem``.

Maps every distinct ``(l_orderkey, l_linenumber)`` onto the raw clinical
schema (8 numeric features, zeros meaning "missing" in five of them) with a
unique ``row_id`` and a planted binary ``Outcome``. This only shapes input
rows; every operator downstream works on any table of this schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.hashing import uniform01
from riskloom.sources.tables import table


def cohort(spark: SparkSession, sf_dir: str, seed: int = 42) -> DataFrame:
    li = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(
            F.min("l_partkey").alias("pk"),
            F.min("l_suppkey").alias("sk"),
            F.min("l_quantity").alias("qty"),
            F.min("l_extendedprice").alias("price"),
            F.min("l_discount").alias("disc"),
            F.min("l_tax").alias("tax"),
        )
    )
    row_id = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    dbl = lambda c: F.col(c).cast("double") if isinstance(c, str) else c.cast("double")
    zero = F.lit(0.0)
    logit = (
        F.lit(-5.2)
        + F.lit(0.07) * F.col("qty")
        + F.lit(0.03) * (F.col("l_orderkey") % 60)
        + F.col("price") / F.lit(50000.0)
    )
    return li.select(
        row_id.alias("row_id"),
        dbl(F.col("l_linenumber") - 1).alias("Pregnancies"),
        F.when(F.col("disc") == 0, zero).otherwise(F.lit(50.0) + 3 * F.col("qty")).alias("Glucose"),
        F.when(F.col("tax") == 0, zero).otherwise(dbl(45 + F.col("sk") % 60)).alias("BloodPressure"),
        F.when(F.col("pk") % 3 == 0, zero).otherwise(dbl(7 + F.col("pk") % 50)).alias("SkinThickness"),
        F.when(F.col("pk") % 2 == 0, zero).otherwise(dbl(15 + (F.col("pk") * 7) % 600)).alias("Insulin"),
        F.when(F.col("l_orderkey") % 80 == 0, zero)
        .otherwise(F.lit(18.0) + F.col("price") / F.lit(2500.0))
        .alias("BMI"),
        (dbl(78 + (F.col("sk") * 13) % 1500) / F.lit(1000.0)).alias("DiabetesPedigreeFunction"),
        dbl(21 + F.col("l_orderkey") % 60).alias("Age"),
        F.when(uniform01(seed, "y", row_id) < 1 / (1 + F.exp(-logit)), 1).otherwise(0).alias("Outcome"),
    )
