import pytest
from oracle import same_rows

from passagework import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_agrees_with_sql(spark, data, name):
    same_rows(spark, data, catalog.queries()[name], catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, data, name):
    assert catalog.queries()[name](spark, data).count() > 0
