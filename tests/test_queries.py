"""Every registered query against its SQL check on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.check import compare, connect

QUERIES = entry.queries()
CHECKS = entry.oracle_sql()
# fitted models have tests of their own with smaller forests
SLOW = {"rf_predict", "rf_metrics", "rf_importance", "model_compare", "model_report"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, sf_dir, con, name):
    assert compare(QUERIES[name](spark, sf_dir), con, CHECKS.get(name)) == ""


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES)


def test_entry_is_lazy_and_has_rows(spark):
    assert entry.entry(spark).count() > 0
