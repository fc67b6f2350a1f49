"""Imports every query module so that all queries are registered."""

from signalbox.plans import (  # noqa: F401
    archive_queries,
    feed_queries,
    rollup_queries,
    schedule_queries,
    state_queries,
    stream_queries,
)
from signalbox.plans.registry import all_oracle_sql, all_queries

__all__ = ["all_oracle_sql", "all_queries"]
