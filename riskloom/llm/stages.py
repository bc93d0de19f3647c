"""The stages of the corpus pipeline: language ID, exact dedup, near-dedup, decontamination, encoding.

Each takes the documents that the stage before kept. All but the last return the
columns of their input. Rows are told apart by themselves, so null or repeated
doc_ids lose nothing. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exact_dedup, language_id, minhash
from .queries import RANKS
from .tables import read, ship, spare_name, written


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected: without a letter, or far from every centroid."""
    ship(spark)
    model = language_id.fit(docs.where(~language_id.held_out()))
    return language_id.predict(docs, model).where("not rejected").select(docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of those with equal texts."""
    ship(spark)
    return exact_dedup.classes(docs).where("kept").select(docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group linked by five-word shingle sets of similarity 0.8 or more."""
    ship(spark)
    row = spare_name(docs.columns, "row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    grouped = minhash.groups(rows, id_col=row, width=5, percent=80).withColumnRenamed("id", row)
    several = grouped.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component_id")
    members = grouped.join(several, "component_id").join(rows.select(row, "doc_id"), row)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("row")))
    stay = members.groupBy("component_id").agg(best.alias("best")).select("component_id", F.col("best.row").alias("stays"))
    gone = members.join(stay, "component_id").where(F.col(row) != F.col("stays")).select(row)
    return rows.join(written(gone, "gone"), row, "left_anti").select(docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a benchmark item in them."""
    found = decontaminate.find(docs, read(spark, sf_dir, "benchmark"))
    return found.where(F.size("matches") == 0).select(docs.columns)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds n_tokens, token_ids, token_starts, and whether the ids decode to the text."""
    ship(spark)
    tokens = bpe.encode(docs, RANKS, and_decode=True)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return tokens.select(*docs.columns, F.expr("octet_length(token_ids) div 4").cast("long").alias("n_tokens"), "token_ids", "token_starts", same.alias("round_trip"))


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontaminate", benchmark_stage),
    ("bpe", encode_stage),
]
