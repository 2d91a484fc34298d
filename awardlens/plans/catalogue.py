"""All registered queries with their oracle SQL, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Plan modules with QUERIES (name -> function) and ORACLES (name -> SQL).
MODULES = ["rollups", "flags", "network", "temporal", "entities", "registers", "extras", "more", "staging", "profiles", "structure", "lookup", "views"]


def _modules():
    from importlib import import_module

    return [import_module(f"awardlens.plans.{m}") for m in MODULES]


def queries() -> dict[str, Query]:
    """Every query of the procurement analytics."""
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """The oracle SQL of the queries that have one."""
    return {k: v for m in _modules() for k, v in m.ORACLES.items()}
