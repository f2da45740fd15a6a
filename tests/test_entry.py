import __spark_entry__ as entry
from ferrule.plans import registry


def test_contract(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and set(registry.queries()) <= set(queries)
    assert {"p1_found", "p3_found", "p4_found"} <= set(sql)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["kind", "binary_id", "address", "detail"]
    assert df.count() >= 0
