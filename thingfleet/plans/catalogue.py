"""All registered queries."""

from __future__ import annotations

from . import axis_queries, change_queries, context_queries, document_queries, graph_queries, rule_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
