"""Registered queries and, where SQL can say it, the independent check for each."""

from packetscope.catalog.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
