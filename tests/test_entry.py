import __spark_entry__ as entry


def test_names_and_smoke(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and entry.entry(spark).count() == 1
