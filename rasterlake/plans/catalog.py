"""Every query over the driver's tables, by name, with its DuckDB SQL where SQL can say it."""

from __future__ import annotations

from rasterlake.plans import box_queries, feature_queries, raster_queries, screen_queries, search_queries, text_queries

QUERIES: dict = {}
SQL: dict[str, str] = {}
for module in (box_queries, feature_queries, raster_queries, screen_queries, search_queries, text_queries):
    QUERIES |= module.QUERIES
    SQL |= module.SQL
