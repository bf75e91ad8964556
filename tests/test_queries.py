from __future__ import annotations

import pytest
from support import database, rows

from quillspark.plans import all_queries, all_sql

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_query_equals_its_sql(spark, con, name):
    mine, other = all_queries()[name](spark, FOLDER).toPandas(), con.execute(all_sql()[name]).df()
    assert sorted(mine.columns) == sorted(other.columns)
    assert rows(mine) == rows(other)


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert all_queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 500
