import os
import re

import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("extra", T.StringType())])


@pytest.fixture(scope="session")
def make(spark, tmp_path_factory):
    """Rows (doc_id, text) as documents with a clashing extra column, in several partitions."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    from riskloom.llm.tables import ship

    ship(spark)

    def run(rows, extra="extra", parts=3):
        schema = T.StructType([*DOCS[:2], T.StructField(extra, T.StringType())])
        return spark.createDataFrame([(i, t, "x") for i, t in rows], schema).repartition(parts)

    return run


@pytest.fixture(scope="session")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


assert os.path.isdir(SF)
