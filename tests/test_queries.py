"""Every registered query of the engine against its SQL, and the driver contract."""

import pytest

import __spark_entry__ as contract
from rangeweave import queries as engine

from compare import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(engine.ORACLE_SQL))
def test_equals_sql(spark, name):
    assert_same(spark, engine.QUERIES[name], engine.ORACLE_SQL[name], SF)


def test_contract(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(engine.QUERIES) <= set(contract.queries())
