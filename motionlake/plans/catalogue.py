"""All queries and their SQL, module by module."""

from __future__ import annotations

from . import archives, contracts, documents, episodes, expansion, export, fusion, gaits, gate, labels, lineage, manipulation, media, motion, poses, quality, reports, sessions, signals, streams, timeline, world

PARTS = (gate, fusion, timeline, manipulation, motion, poses, quality, contracts, labels, export, reports, documents, lineage, signals, gaits, sessions, archives, media, world, episodes, expansion, streams)


def queries() -> dict:
    return {name: run for part in PARTS for name, run in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.oracle_sql().items()}
