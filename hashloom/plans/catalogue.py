"""All queries outside the training-data subpackage."""

from __future__ import annotations

from hashloom.plans import integrity, match_queries, pixel_queries, store_queries

_PARTS = (store_queries, pixel_queries, match_queries, integrity)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
