import pytest
from compare import difference, duck

from callsieve.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert difference(QUERIES[name](spark, SF), duck(SF), ORACLE_SQL[name]) is None
