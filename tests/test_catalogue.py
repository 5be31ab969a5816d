import pytest

import __spark_entry__ as entry
from cadenza.plans import catalogue3
from tests.duck import connect, same


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue3.ORACLE))
def test_query_equals_oracle(spark, sf_dir, duck, name):
    same(catalogue3.QUERIES[name](spark, sf_dir), catalogue3.ORACLE[name], duck)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registry_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
