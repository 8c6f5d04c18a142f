"""Every registered query against its SQL at the smallest scale."""

import pytest
from oracle import compare, connect

from recordshield.queries import load

SMALL = "/root/testdata/sf0.001"
QUERIES, SQL = load()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    result = compare(spark, con, SMALL, name, QUERIES[name], SQL.get(name))
    assert result.startswith(("ok", "rows")), result


def test_every_query_reads_the_tables():
    assert len(QUERIES) > 180
    assert len(SQL) == len(QUERIES)
