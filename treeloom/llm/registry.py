"""Every query of this package by name."""

from __future__ import annotations

from treeloom.llm import queries_exact, queries_files, queries_text

_MODULES = [queries_exact, queries_files, queries_text]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
