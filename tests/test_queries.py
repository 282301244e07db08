"""Every query that has SQL equals it, on the smallest tables here and on larger ones in the driver's check."""

import pytest

from tests.oracle import connect, rows_of, rows_of_sql
from viewspan.plans.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_equals_sql(spark, con, name):
    q = QUERIES[name]
    (names, a), (columns, b) = rows_of(q.run(spark, SF)), rows_of_sql(con, q.oracle())
    assert names == columns
    assert len(a) == len(b) and a
    different = [(x, y) for x, y in zip(a, b) if x != y]
    assert not different, different[:3]
