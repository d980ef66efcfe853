import __spark_entry__ as driver
from statwright.plans import catalog


def test_names_and_sql_agree():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(catalog.SQL) <= set(catalog.QUERIES)


def test_flagship(spark):
    got = driver.entry(spark)
    assert got.columns == ["category", "spent_cents", "transactions", "share", "matching"]
    assert got.count() == 6
