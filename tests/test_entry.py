import __spark_entry__ as driver
from tests.oracle import compare, duck


def test_entry_matches_its_sql(spark):
    assert compare(driver.entry(spark), driver.oracle_sql()["walk_forward_summary"], duck(driver.SMOKE)) is None
