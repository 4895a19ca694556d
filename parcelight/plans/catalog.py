"""Registered queries over the driver's tables, each an operator of the library on a shape of its own, and the SQL that
recomputes it."""

from __future__ import annotations

from . import business, geometry, nested, relational, serving, spatial, stateful, text

_MODULES = (relational, text, spatial, nested, business, stateful, serving, geometry)
QUERIES = {name: run for m in _MODULES for name, run in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
