import pytest
from sqlcheck import SF, same

from tessera.llm import registry


@pytest.mark.parametrize("name", registry.SQL)
def test_against_sql(spark, name):
    same(spark, registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", [k for k in registry.QUERIES if k not in registry.SQL])
def test_runs_on_the_smallest_tables(spark, name):
    assert registry.QUERIES[name](spark, SF).columns
