"""Every registered query against its SQL in DuckDB."""

import pytest

import __spark_entry__ as entry
from tidegauge.plans.catalog import QUERIES, SQL
from tools.compare import compare, connect


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, con, folder, name):
    result, _ = compare(spark, con, QUERIES[name], SQL[name], folder)
    assert result == "ok"


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
