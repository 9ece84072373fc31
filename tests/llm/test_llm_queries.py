import pytest

from stratavec.llm import queries as llm

SQL = llm.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_what_its_sql_gives(same, name):
    same(llm.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert llm.queries()[name](spark, "/root/testdata/sf0.001").count() >= 0
