"""Every query of the library runs on the smallest tables, and equals its SQL twin where it has one."""

import pytest

from compare import assert_same, views
from gristmill.plans import catalogue

SLOW = {"walkforward_rf", "truncation_invariance"}


@pytest.fixture(scope="module")
def con(small):
    return views(small)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES.keys() - SLOW))
def test_equals_sql(spark, small, con, name):
    assert_same(catalogue.QUERIES[name](spark, small), catalogue.ORACLES[name], con)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES.keys() - catalogue.ORACLES.keys() - SLOW))
def test_runs(spark, small, name):
    df = catalogue.QUERIES[name](spark, small)
    assert df.columns
    df.collect()


def test_entry(spark, small):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
