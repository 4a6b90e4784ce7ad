"""Queries by name, and the SQL that each must agree with."""

from __future__ import annotations

from . import change_queries, chart_queries, file_queries, panel_queries, report_queries, series_queries, store_queries

MODULES = (series_queries, store_queries, change_queries, chart_queries, report_queries, file_queries, panel_queries)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
