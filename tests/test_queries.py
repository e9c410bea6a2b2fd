"""Every registered query against its SQL (or for rows), on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_entry(spark):
    assert entry.entry(spark).count() == 11


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name]) == ""


# the heavier fits have tests of their own on small fixtures
@pytest.mark.parametrize("name", ["feature_importance", "score_proba", "tree_contributions", "rf_regress", "logistic",
                                  "tune_forest"])
def test_gives_rows(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() > 0
