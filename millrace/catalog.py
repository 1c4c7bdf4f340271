"""Every registered query of the search engine, and its SQL."""

from __future__ import annotations

from millrace.queries import graph, intake, listings, logs, pages, search, upkeep, words

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _part in (search, words, logs, graph, upkeep, listings, pages, intake):
    QUERIES |= _part.QUERIES
    SQL |= _part.SQL
