"""Every query of the subpackage that has SQL, against it on a small table."""

import pytest
from oracle import compare

from doctriage.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    assert compare(QUERIES[name](spark, FOLDER), SQL[name], FOLDER) > 0


def test_one_query_for_each_operator():
    assert sorted({int(n[2:].split("_")[0]) for n in QUERIES}) == list(range(1, 14))
