"""All registered queries of the engine and the SQL they are held against."""

from __future__ import annotations

from quillspan.plans import context, data, extra, metrics, more, spans

MODULES = (spans, metrics, data, more, extra, context)
QUERIES: dict = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for m in MODULES for name, sql in m.SQL.items()}
