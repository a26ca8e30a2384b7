"""The registered queries, each with the SQL that must give the same rows on another engine."""

from __future__ import annotations

from . import aggregates, collections, dml, families, joins, relational, scalar, sql, streams, windows
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
