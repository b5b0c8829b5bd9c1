"""All queries of the core and their SQL."""

from __future__ import annotations

from palimpsest.plans import context, events, graphs, memory, more, problems, quality, records, texts

MODULES = [problems, memory, events, quality, texts, graphs, context, records, more]


def queries():
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql():
    return {k: s for m in MODULES for k, s in m.SQL.items()}
