"""Registered queries over the star schema and the text tables, and their DuckDB twins."""

from . import contract_queries, event_queries, graph_queries, record_queries, text_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
