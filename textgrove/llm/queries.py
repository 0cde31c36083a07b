"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from . import document_queries, shared_queries, split_queries, subject_queries, vector_queries

_MODULES = (split_queries, shared_queries, vector_queries, document_queries, subject_queries)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
