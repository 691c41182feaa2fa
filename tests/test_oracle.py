"""Every registered query with oracle SQL, against DuckDB on the small
driver tables (the driver repeats this at sf0.01)."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL
from tools.oracle_check import TABLES, check

SQL = entry.oracle_sql()

#: Queries that fit whole ensembles, tens of seconds each whatever the input;
#: their parts are tested in test_train.py, and tools/oracle_check.py runs them.
FITS = {"cv_random_forest", "out_of_fold_predictions", "model_test_metrics", "first_important_feature",
        "grid_search_random_forest", "evaluate_held_out", "scored_corpus_proof", "model_save_load"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(SQL) - FITS))
def test_query_matches_oracle(spark, con, name):
    res = check(spark, con, SF_SMALL, name, entry.queries()[name], SQL[name])
    assert res["status"] == "OK", res


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "cyclomatic_complexity" in df.columns
