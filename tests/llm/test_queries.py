"""Every query of this subpackage on the smallest tables; those with a SQL twin against it."""

import pytest
from conftest import SMALL, duck_rows, rows_of

from evispark.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = rows_of(QUERIES[name](spark, SMALL))
    if name in SQL:
        assert got == duck_rows(SQL[name], SMALL)
