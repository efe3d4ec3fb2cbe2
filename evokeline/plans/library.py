"""All queries of the library by name."""

from __future__ import annotations

from . import aggregate_queries, decode_queries, event_queries, signal_queries, source_queries, stats_queries  # noqa: F401  they register their queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
