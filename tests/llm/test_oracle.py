import os

import pytest

from leafmill.llm.queries import QUERIES, SQL
from tests.oracle import FOLDER, compare


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name])
