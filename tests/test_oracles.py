"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import compare

from doctriage.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, FOLDER)
    if name in SQL:
        assert compare(df, SQL[name], FOLDER) > 0
    else:
        assert df.count() > 0


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
