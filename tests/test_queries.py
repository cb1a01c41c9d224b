"""Every query with SQL has the rows that DuckDB finds; the others run and are not empty."""

import pytest

from lotwise import queries
from tests.conftest import SF, same_rows


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
