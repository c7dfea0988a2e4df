import pytest

from oracle import difference
from tessera import plans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n, (_, sql) in plans.QUERIES.items() if sql])
def test_equals_its_sql(spark, name):
    query, sql = plans.QUERIES[name]
    assert difference(spark, query, sql, SF) is None


@pytest.mark.parametrize("name", [n for n, (_, sql) in plans.QUERIES.items() if not sql])
def test_runs(spark, name):
    assert plans.QUERIES[name][0](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
