"""Queries by name and their SQL."""

from __future__ import annotations

from .plans import contexts, more, retrieval, stats, streams, texts

QUERIES = retrieval.QUERIES | texts.QUERIES | stats.QUERIES | contexts.QUERIES | more.QUERIES | streams.QUERIES
SQL = retrieval.SQL | texts.SQL | stats.SQL | contexts.SQL | more.SQL | streams.SQL
FLAGSHIP = "top01_knn"
