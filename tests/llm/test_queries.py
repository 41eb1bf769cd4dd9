import pytest

from tests.compared import FOLDER, same
from traceloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, name):
    same(spark, name, queries.QUERIES, queries.SQL)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, FOLDER).count() >= 0
