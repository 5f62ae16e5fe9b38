"""Registered queries with their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    """Register a query under its name, with SQL that must give the same rows."""

    def register(build: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, build, sql)
        return build

    return register


def load() -> dict[str, Query]:
    """Import every catalogue module and return the registry."""
    from . import execution, ingest, jobs, loadtest, metrics, streams, workload  # noqa: F401

    return REGISTRY
