import __spark_entry__ as E


def test_entry(spark):
    assert E.entry(spark).count() > 0


def test_names():
    assert set(E.oracle_sql()) <= set(E.queries())
