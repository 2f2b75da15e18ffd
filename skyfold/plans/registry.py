"""The queries of the library and the SQL that checks them."""

from __future__ import annotations

from skyfold.plans import kernel_queries, result_queries, spatial_queries, village

_PARTS = (spatial_queries, result_queries, kernel_queries, village)
QUERIES: dict = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: sql for part in _PARTS for k, sql in part.ORACLE_SQL.items()}
