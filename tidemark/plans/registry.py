"""All queries of the engine by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import engines, flow, institution, live, market, momentum, precise, state, verdict, votes

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (market, momentum, flow, live, engines, precise, verdict, institution, votes, state)


def queries() -> dict[str, Query]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
