import pytest

from shelfspark.llm import queries

from ..oracle import differs, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert differs(spark, duck(SF), queries.QUERIES[name], queries.ORACLES[name], SF) == ""
