"""Registered queries of the core operators and their SQL counterparts."""

from __future__ import annotations

from . import engines, features, indexing, reductions

MODULES = [features, indexing, reductions, engines]


def queries():
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql():
    return {name: q for m in MODULES for name, q in m.ORACLES.items()}
