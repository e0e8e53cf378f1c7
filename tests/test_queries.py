"""Every query of the library against its SQL."""

import pytest
from helpers import SF, against_duckdb

from partloom.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    found = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        against_duckdb(found, ORACLE_SQL[name])
    else:  # an approximate search, whose recall test_searches measures
        assert name == "vector_index_top_k" and found.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
    assert set(QUERIES) <= set(e.queries())
