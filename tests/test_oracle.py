"""Every core query with SQL gives the rows of that SQL."""

import pytest

from oracle import connection, same, split_otherwise
from tidemark import queries as core

NAMES = sorted(core.oracle_sql())


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, con, name):
    same(spark, sf, core.queries()[name], core.oracle_sql()[name], con)


#: Queries that find nothing in the given data (the last two only in its smallest size); their operators are tested on small cases.
EMPTY = {"scheduled_jobs", "declared_dependencies", "entry_points", "external_dependencies", "json_found_in_text"}


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(NAMES)))
def test_query_without_sql_does_not_depend_on_the_split(spark, sf, name):
    assert split_otherwise(spark, sf, core.queries()[name]) or name in EMPTY


def test_entry_has_stable_schema(spark, sf):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.schema == __spark_entry__.entry(spark).schema
    assert set(core.queries()) <= set(__spark_entry__.queries())
