"""All core queries and their SQL."""

from __future__ import annotations

from marginalia.queries import general, plans, vault, vault_sql

_QUERIES, _SQL = (general, vault, plans), (general, vault_sql, plans)
FLAGSHIP = "tfidf_knn"
QUERIES = {name: f for m in _QUERIES for name, f in m.QUERIES.items()}
SQL = {name: s for m in _SQL for name, s in m.SQL.items()}
