"""Registered queries: each module's ``QUERIES`` maps a name to (function, DuckDB SQL or None)."""

from __future__ import annotations

from tallyline.queries import comparison, constraints, contracts, decisions, documents, extensions, facts, files, lifecycle, outputs, recompute, registry, relay, scalars, streams

MODULES = (comparison, scalars, facts, outputs, documents, files, registry, lifecycle, decisions, recompute, extensions, streams, relay, contracts, constraints)


def all_queries() -> dict:
    return {name: pair for m in MODULES for name, pair in m.QUERIES.items()}
