import pytest
from compare import rows_of, rows_of_sql, views

from corpusmill.plans import files, files_sql, oracle, queries

SQL = oracle.oracle_sql() | files_sql.oracle_sql()
QUERIES = queries.queries() | files.queries()


@pytest.fixture(scope="module")
def con(small):
    return views(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, small, con, name):
    assert rows_of(QUERIES[name](spark, small)) == rows_of_sql(con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0
