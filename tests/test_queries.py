"""Every core query with SQL gives the rows of its SQL on the small tables."""

import pytest
from compare_rows import rows_of

from sievewright import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = queries.queries()[name](spark, SMALL)
    found = duck.execute(queries.oracle_sql()[name])
    columns = [x[0] for x in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, found.fetchall())


def test_every_sql_has_a_query():
    assert set(queries.oracle_sql()) <= set(queries.queries())
