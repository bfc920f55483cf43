"""Queries of the library by name, and SQL that gives the same rows."""

from __future__ import annotations

from .queries import assembly, books, corpus, files, programs, relations, views  # noqa: F401  register their queries
from .queries.scalars import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
