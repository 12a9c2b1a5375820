import pytest

import __spark_entry__
from pagewright import queries
from tests.oracle import DATA, connection, same


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    same(queries.QUERIES[name](spark, DATA), queries.ORACLES[name], connection())


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_layout_query_has_sql():
    assert set(queries.QUERIES) - set(queries.ORACLES) == {"enhanced_pixels"}  # tested by plain loops
