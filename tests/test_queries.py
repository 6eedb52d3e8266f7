"""Every registered engine query against DuckDB, at the smallest scale."""

import pytest

from murmuration.plans import registry

from .conftest import SMALL, same_rows

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, duck, name):
    found = registry.queries()[name](spark, SMALL).toPandas()
    same_rows(found, duck.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    out = registry.queries()[name](spark, SMALL)
    assert out.count() > 0
    assert len(set(out.columns)) == len(out.columns)


def test_entry(spark):
    import __spark_entry__

    rows = {r["scheme"]: r for r in __spark_entry__.entry(spark).collect()}
    assert rows["before"]["n"] == 1000
    for name, row in rows.items():
        assert abs(row["mean"] - rows["before"]["mean"]) < 3.0, name  # a small effective size
