"""Registered queries: name -> (Spark job over the driver tables, DuckDB oracle).

Each job takes ``(spark, sf_dir)`` and returns a DataFrame over whole tables.
Oracle bodies are SQL over the views of ``permgrid.plans.oracle``; ``None``
means the result is not expressible on the base tables (rows-only check).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from permgrid.plans.oracle import with_views

Job = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    job: Job
    sql: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Job) -> Job:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql)
        return fn
    return deco


def _load_all() -> None:
    # importing the modules fills REGISTRY
    from permgrid.plans import queries_access  # noqa: F401
    from permgrid.plans import queries_admin  # noqa: F401
    from permgrid.plans import queries_files  # noqa: F401
    from permgrid.plans import queries_sessions  # noqa: F401


def all_queries() -> dict[str, Job]:
    _load_all()
    return {n: q.job for n, q in REGISTRY.items()}


def all_oracles() -> dict[str, str]:
    _load_all()
    return {n: with_views(q.sql) for n, q in REGISTRY.items() if q.sql is not None}
