"""Named queries with their SQL counterparts; each runs over its whole tables."""

from __future__ import annotations

from . import entities, files, labels, other, relational, similarity, text
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "entities", "files", "labels", "other", "relational", "similarity", "text"]
