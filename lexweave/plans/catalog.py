"""All queries of the core, by name, and their SQL twins."""

from __future__ import annotations

from lexweave.plans import linking_queries, linking_sql, nested_queries

QUERIES = {**linking_queries.QUERIES, **nested_queries.QUERIES}
SQL: dict[str, str] = {**linking_sql.SQL, **nested_queries.SQL}
FLAGSHIP = "matches_by_community"
