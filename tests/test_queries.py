import pytest

from tests.compared import FOLDER, same
from traceloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, name):
    same(spark, name, registry.QUERIES, registry.SQL)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).columns
