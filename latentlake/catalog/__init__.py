"""Registered queries with their SQL statements, one or more per operator."""

from latentlake.catalog.base import all_oracles, all_queries

__all__ = ["all_oracles", "all_queries"]
