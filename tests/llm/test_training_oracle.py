"""Queries of the subpackage against their SQL; those without it give the same rows however the work is split."""

import pytest

from oracle import connection, same, split_otherwise
from tidemark.llm import queries as llm


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, sf, con, name):
    same(spark, sf, llm.queries()[name], llm.oracle_sql()[name], con)


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(llm.oracle_sql())))
def test_query_does_not_depend_on_the_split(spark, sf, name):
    rows = split_otherwise(spark, sf, llm.queries()[name], leave_out=("confidence",))  # the first letters of a part are scored after those of the part before it
    assert rows
