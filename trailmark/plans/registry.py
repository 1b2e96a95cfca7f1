"""Registry of the analyses bound to the test data.

Each entry pairs the Spark plan (a function of the derived tables) with its oracle SQL, keeping the
two forms of one analysis side by side. Dates of the original analyses (2012-2014) are mapped onto
the test data's ranges: clickstream January 2024, store orders 1995-2001. Every entry reads whole
tables; date windows are part of an analysis, never a cost cap.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from trailmark.sources import CommerceData


@dataclass(frozen=True)
class Entry:
    key: str
    work_id: str
    build: Callable[[CommerceData], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def register(key: str, work_id: str, sql: str | None):
    """Decorator: register ``build(data) -> DataFrame`` under ``key`` with its oracle SQL."""

    def wrap(build: Callable[[CommerceData], DataFrame]):
        if key in REGISTRY:
            raise KeyError(f"duplicate query key {key}")
        REGISTRY[key] = Entry(key, work_id, build, sql)
        return build

    return wrap


def _load_all() -> None:
    # importing the modules fills REGISTRY
    from trailmark.plans import (  # noqa: F401
        q_experiments,
        q_funnels,
        q_pages,
        q_products,
        q_traffic,
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()

    def bind(entry: Entry) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return entry.build(CommerceData(spark, sf_dir))

        run.__name__ = entry.key
        run.__doc__ = f"{entry.work_id} {entry.key}"
        return run

    return {k: bind(e) for k, e in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: e.sql for k, e in REGISTRY.items() if e.sql is not None}
