import pytest
from compare import difference, duck

import __spark_entry__ as entry_points
from callsieve.plans.oracles import ORACLE_SQL
from callsieve.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_sql_text_belongs_to_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert set(QUERIES) - {"control_scores"} == set(ORACLE_SQL)  # tests/test_boosting.py has its brute-force version


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    assert difference(entry_points.queries()[name](spark, SF), con, entry_points.oracle_sql()[name]) is None
