"""Queries over the driver's tables, each with the SQL that states the same result."""

from __future__ import annotations

from cueframe.plans import alignment, repairs, stages, text, timeline

MODULES = (text, timeline, stages, repairs, alignment)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
