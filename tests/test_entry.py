import __spark_entry__ as e


def test_entry(spark):
    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert {"p1_found", "hybrid_search"} <= set(e.queries())
