"""All query modules, collected."""

from __future__ import annotations

from queries import engine, relational, scalars, sqltext

MODULES = (relational, scalars, engine, sqltext)


def queries():
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql():
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
