"""All queries and their SQL twins."""

from __future__ import annotations

from . import decisions, governance, ingest, monitoring, quality, similarity, streams, summaries, text

MODULES = (ingest, text, similarity, decisions, quality, monitoring, governance, streams, summaries)


def queries() -> dict:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in MODULES for name, s in m.SQL.items()}
