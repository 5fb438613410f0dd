"""Registration, and the queries that SQL can express."""

import re

import pytest

import __spark_entry__
from oracle import check
from shardsort.llm import registry


def test_one_query_for_each_operator_and_the_pipeline():
    names = list(__spark_entry__.queries())
    numbers = sorted(int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n)))
    assert numbers == list(range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, small, name):
    check(spark, name, small, registry.queries(), registry.oracle_sql())
