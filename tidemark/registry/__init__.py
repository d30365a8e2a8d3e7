"""Named queries: each pairs a Spark job with, where one exists, the same question in ANSI SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.registry.ctes import with_ctes
from tidemark.sources.catalog import Catalog

Job = Callable[[SparkSession, str], DataFrame]

JOBS: dict[str, Job] = {}
ORACLES: dict[str, str] = {}

_MODULES = (
    "market", "trends", "landing", "selection", "joining", "summaries", "ordering", "scalars_text", "scalars_time",
    "reports", "pages", "ratios", "learning", "streams",
)


def job(name: str, sql: str | None = None):
    """Register ``fn(catalog) -> DataFrame`` under ``name``; ``sql`` may use the shared CTEs."""

    def wrap(fn: Callable[[Catalog], DataFrame]):
        if name in JOBS:
            raise ValueError(f"query {name} registered twice")
        JOBS[name] = lambda spark, sf_dir: fn(Catalog(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return fn

    return wrap


def load_all() -> None:
    for module in _MODULES:
        importlib.import_module(f"tidemark.registry.{module}")
