"""Every query with an SQL text equals DuckDB's result on the same files."""

import pytest
from oracle import compare

from plumbline import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_oracle(spark, name):
    assert compare(spark, queries.Q[name], queries.SQL[name], SF) == ""


def test_entry_has_all(spark):
    import __spark_entry__ as e

    assert set(queries.Q) <= set(e.queries())
    assert e.entry(spark).count() == 6
