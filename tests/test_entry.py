import __spark_entry__ as e


def test_registry():
    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries) and len(sql) > 50
    assert "rank_tfidf" in queries
