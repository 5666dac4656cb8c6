"""Registered queries: importing this package fills the registry."""

from shirabe.catalog import events, incremental, jobs, joins, marketing, quality, relational, scalars, scans
from shirabe.catalog.registry import QUERIES, SQL, Tables, query

__all__ = ["QUERIES", "SQL", "Tables", "query"]
