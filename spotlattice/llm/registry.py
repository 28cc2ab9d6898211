"""Queries and SQL of the corpus operators."""

from spotlattice.llm import centroids, chat, compressed, decontaminate, fim, jaccard, language, licenses, pieces, pii, quality, tokenids, urls

_MODULES = (quality, licenses, chat, language, urls, decontaminate, pieces, pii, jaccard, tokenids, fim, centroids, compressed)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
