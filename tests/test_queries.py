import pytest

from shelfspark.plans import registry

from .oracle import differs, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    assert differs(spark, con, registry.QUERIES[name], registry.ORACLES[name], SF) == ""


def test_event_ids_are_stable(spark):
    a, b = (sorted(map(tuple, registry.QUERIES["event_ids"](spark, SF).collect())) for _ in range(2))
    assert a == b and all(len(r[3]) == 24 for r in a)
