import __spark_entry__ as entry


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert {"roc_rates", "p5_found", "pair_unique"} <= set(queries)
