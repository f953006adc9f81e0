import pytest

from catalink.plans.catalog import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, same_as_sql, name):
    same_as_sql(QUERIES[name](spark, "/root/testdata/sf0.001"), SQL[name])


@pytest.mark.parametrize("name", ["char_sequences", "p6_delimiters"])
def test_query_runs(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry_without_training_part():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
