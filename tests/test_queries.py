import pytest

from ferrolith import plans

from .conftest import SF

QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, same, name):
    same(QUERIES[name](spark, SF), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_is_stable(spark, name):
    """The same rows when all joins and groups are dealt over another number of partitions; never none."""
    rows = lambda: sorted(map(repr, QUERIES[name](spark, SF).collect()))
    first = rows()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert first and rows() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_entry_needs_no_text_operators(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
