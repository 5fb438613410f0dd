"""Every record-sort query equals its SQL."""

import pytest

from oracle import check
from shardsort.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, small, name):
    check(spark, name, small, catalog.queries(), catalog.oracle_sql())


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_sample_keys_repeat_and_follow_the_budget(spark, small):
    draw = catalog.queries()["sample_keys"]
    first, again = draw(spark, small), draw(spark, small)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))
    budget = {r["src"]: r["n_samples"] for r in catalog.queries()["sample_budget"](spark, small).collect()}
    counts = {r["src"]: r["count"] for r in first.groupBy("src").count().collect()}
    assert counts == {k: v for k, v in budget.items() if v}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 200
