"""Every registered query against its comparison SQL, at the smallest scale."""

import pytest
from conftest import SF_SMALL

from check_queries import compare, duck
from tarifflow.plans.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    verdict = compare(spark, con, SF_SMALL, name)
    assert verdict.startswith("ok" if name in ORACLES else "rows-only"), verdict


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
