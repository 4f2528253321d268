import __spark_entry__ as E


def test_registry_and_oracle_keys():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(sql) >= 55


def test_entry_runs(spark):
    rows = E.entry(spark).collect()
    assert len(rows) == 1 and rows[0].n_test > 0
