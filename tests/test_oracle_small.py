"""Registered queries vs their DuckDB oracle on the smallest scale factor."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from riskloom.plans.queries import QUERIES
from tests.conftest import SF_SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Base queries without SQL: trained models and what is derived from them; their own tests check them.
ROWS_ONLY = {"train_model", "calibrate_sigmoid", "file_inventory", "candidate_cv", "fs_summary", "fs_stability",
             "search_tune", "calibrate_trained", "cv_fold_refits", "nested_cv_audit", "production_model"}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in recs), key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


#: DuckDB needs minutes for its 250 resamples; tests/test_metrics_policy.py compares fewer with numpy.
SLOW = {"bootstrap_ci"}


@pytest.mark.parametrize("key", sorted(set(QUERIES) - ROWS_ONLY - SLOW))
def test_query_matches_oracle(spark, con, key):
    df = entry.queries()[key](spark, SF_SMALL)
    res = con.execute(entry.oracle_sql()[key])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(dcols, res.fetchall())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "risk_priority_rank" in df.columns


def test_every_base_query_has_an_oracle():
    assert set(QUERIES) - set(entry.oracle_sql()) == ROWS_ONLY
