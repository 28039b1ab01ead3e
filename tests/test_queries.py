"""Every engine query against its oracle, on the smallest tables."""

import pytest
from oracle import same

from triplewright.plans.catalog import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, name):
    same(spark, QUERIES[name], ORACLES[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_has_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
