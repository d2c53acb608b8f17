"""Registry of the engine's queries and their DuckDB equivalents over the test tables."""

from __future__ import annotations

from quern.catalog.base import ORACLE_SQL, QUERIES
from quern.catalog import etl, media, news, policies, search, texts  # noqa: F401  they register queries

__all__ = ["ORACLE_SQL", "QUERIES"]
