"""Every query that has a SQL twin returns the twin's rows; the others return rows."""

import pytest

from quietday.queries import ORACLE_SQL, QUERIES
from tests.twin import assert_twin, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_twin(spark, con, sf, name):
    assert_twin(spark, con, sf, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
