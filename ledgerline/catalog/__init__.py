"""The registered queries: each family's module has QUERIES, name -> (function of spark and folder, DuckDB SQL or None)."""

from __future__ import annotations

from . import files, lookups, metadata, performance, selection, streams

REGISTRY = performance.QUERIES | selection.QUERIES | metadata.QUERIES | streams.QUERIES | lookups.QUERIES | files.QUERIES
