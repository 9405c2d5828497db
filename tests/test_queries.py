import pytest
from sqlcheck import SF, same

from tessera.plans import context, general, lookups, texts, usage
from tessera.streaming import events

ALL = {k: (f, m.SQL[k]) for m in (general, context, lookups, texts, usage, events) for k, f in m.QUERIES.items()}


@pytest.mark.parametrize("name", ALL)
def test_against_sql(spark, name):
    same(spark, *ALL[name])


def test_the_flagship_query_keeps_its_budget(spark):
    used = texts.greedy_budget(spark, SF).groupBy("task_text").sum("tokens").collect()
    assert used and all(r[1] <= 1000 for r in used)
