import pytest

from tests.conftest import DATA
from tessergrid import registry
import __spark_entry__ as entry

WITH_SQL = sorted(registry.oracles())
WITHOUT = sorted(set(registry.QUERIES) - set(WITH_SQL))


@pytest.mark.parametrize("name", WITH_SQL)
def test_matches_sql(name, same):
    same(name)


@pytest.mark.parametrize("name", WITHOUT)
def test_gives_rows(name, spark):
    assert entry.queries()[name](spark, DATA).limit(1).count() == 1


def test_entry(spark):
    assert entry.entry(spark).count() == 10
