"""Registers functions of a Domain as queries with their oracle SQL."""

from __future__ import annotations

from awardlens.sources.tables import Domain


def registry():
    """QUERIES, ORACLES and the decorator that fills them."""
    queries, oracles = {}, {}

    def query(sql: str | None = None):
        def keep(f):
            queries[f.__name__] = lambda spark, sf_dir: f(Domain(spark, sf_dir))
            if sql is not None:
                oracles[f.__name__] = sql
            return f

        return keep

    return queries, oracles, query
