"""Every named query with its SQL."""

from __future__ import annotations

from . import queries_eval, queries_graph, queries_more, queries_packed, queries_reads, queries_simplify

_MODULES = (queries_reads, queries_eval, queries_graph, queries_more, queries_simplify, queries_packed)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
