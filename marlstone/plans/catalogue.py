"""The registered queries of the engine and the SQL that says what each must return."""

from __future__ import annotations

from . import aggregates, expressions, joins, ordering, scalars, scans, sets, subqueries, windows
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "aggregates", "expressions", "joins", "ordering", "scalars", "scans", "sets", "subqueries", "windows"]
