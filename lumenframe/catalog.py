"""Every registered query by name with the SQL it is held against."""

from __future__ import annotations

from lumenframe.queries import aggregates, columnar, elements, facades, joins, selection, shapes, surface, vectors, windows
from lumenframe.queries.registry import ORACLE, QUERIES, Query, register, table

__all__ = ["ORACLE", "QUERIES", "Query", "aggregates", "columnar", "elements", "facades", "joins", "register", "selection", "shapes", "surface", "table", "vectors", "windows"]
