"""All registered queries of the engine and their oracle SQL (the llm subpackage has its own)."""

from __future__ import annotations

from spindrift.queries import analyses, graphs, measures, readouts, services, streams

_MODULES = (graphs, measures, analyses, readouts, services, streams)


def queries():
    return {name: f for module in _MODULES for name, f in module.QUERIES.items()}


def oracle_sql():
    return {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
