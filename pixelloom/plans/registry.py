"""All queries of the engine by name, and their SQL."""

from __future__ import annotations

from . import decisions, learning, planes8, relational

_MODULES = (planes8, decisions, relational, learning)
QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
SQL = {name: q for m in _MODULES for name, q in m.SQL.items()}
