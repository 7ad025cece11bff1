"""Every registered query on the smallest tables, next to its SQL where there is some."""

import compare
import pytest
from conftest import SF_DIR

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF_DIR).toArrow()
    if name in ORACLES:
        assert compare.differences(found, duck.sql(ORACLES[name]).to_arrow_table()) == []
    else:
        assert found.num_rows > 0
