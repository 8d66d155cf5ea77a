"""Registered queries: SQL where there is some, and a stable schema."""

import pytest

import __spark_entry__ as entry
from tidegauge.llm.queries import QUERIES, SQL
from tools.compare import compare, connect


@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, folder, name):
    result, _ = compare(spark, connect(folder), QUERIES[name], SQL[name], folder)
    assert result == "ok"


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{n}" for n in range(1, 14)}
