"""All registered queries."""

from tidegauge.plans import (  # noqa: F401
    aggregate_queries,
    check_queries,
    column_queries,
    filter_queries,
    ordered_queries,
    source_queries,
    streaming_queries,
)
from tidegauge.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
