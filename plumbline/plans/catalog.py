"""All queries of the engine: importing the modules registers them."""

from __future__ import annotations

from . import aggregates, graph, joins, measure, networks, ordered, scalars, sheets  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
