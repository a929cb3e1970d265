"""The registered queries: each operator over the driver's tables, with equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Registered:
    run: Query
    sql: str | None


REGISTRY: dict[str, Registered] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its SQL when there is one."""

    def register(run: Query) -> Query:
        REGISTRY[run.__name__] = Registered(run, sql)
        return run

    return register


def load() -> dict[str, Registered]:
    """All registered queries, in the order of their families."""
    from tablewright.queries import conversions, files, plans, prep, relational, scoring, sketches, tables, texts  # noqa: F401

    return REGISTRY
