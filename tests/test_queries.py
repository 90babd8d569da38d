"""Every registered query against its SQL twin over the same tables."""

import __spark_entry__ as entry_point
import pytest
from compare import database, differences

from orderlens.plans.oracles import ORACLES
from orderlens.plans.registry import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    return database(SF)


def test_every_query_has_a_twin():
    assert set(ORACLES) == set(QUERIES)
    assert QUERIES.items() <= entry_point.queries().items()
    assert ORACLES.items() <= entry_point.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    result = QUERIES[name](spark, SF).toArrow()
    assert result.num_rows > 0
    assert differences(result, db.sql(ORACLES[name]).to_arrow_table()) == []


def test_entry(spark):
    assert entry_point.entry(spark).count() == 5
