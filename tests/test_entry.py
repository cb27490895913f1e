import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 0
    assert df.columns == ["column_name", "pos", "severity", "errors_found"]


def test_every_query_has_name_and_callable():
    qs = E.queries()
    assert len(qs) > 0
    assert set(E.oracle_sql()) <= set(qs)
