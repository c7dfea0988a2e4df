import pytest

from oracle import difference
from tessera.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_its_sql(spark, name):
    assert difference(spark, queries.queries()[name], queries.oracle_sql()[name], "/root/testdata/sf0.001") is None
