import os

import pytest

from leafmill.queries import load
from tests.oracle import FOLDER, compare

QUERIES, SQL = load()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name])


def test_every_sql_has_a_query():
    assert not set(SQL) - set(QUERIES)
