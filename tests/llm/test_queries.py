import pytest

import __spark_entry__
from storyloom.llm.queries import oracle_sql, parts, parts_sql, queries

from ..compare import compare


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_rows_are_those_of_the_sql(spark, name):
    assert compare(spark, queries()[name], oracle_sql()[name]) > 0


@pytest.mark.parametrize("name", sorted(parts_sql()))
def test_rows_of_the_parts_are_those_of_the_sql(spark, name):
    assert compare(spark, parts()[name], parts_sql()[name]) > 0


def test_parts_are_registered_beside_the_operators():
    names = __spark_entry__.queries()
    assert set(parts()) == set(parts_sql()) and set(parts()) | set(queries()) <= set(names) and not set(parts()) & set(queries())
    assert set(parts_sql()) | set(oracle_sql()) <= set(__spark_entry__.oracle_sql()) <= set(names)
    assert [n for n in queries() if not n.startswith("op")] == []
