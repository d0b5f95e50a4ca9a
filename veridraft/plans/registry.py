"""All queries of the core, and the SQL to hold against them."""

from __future__ import annotations

from . import reference

_MODULES = [reference]

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
