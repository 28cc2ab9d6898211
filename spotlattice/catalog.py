"""All registered queries of the spatial operators with their SQL."""

from __future__ import annotations

from spotlattice.plans import q_claims, q_cluster, q_graph, q_ledger

_MODULES = (q_ledger, q_claims, q_graph, q_cluster)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
