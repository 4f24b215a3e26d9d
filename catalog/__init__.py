"""Registered queries: each Spark job beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    """Decorator: the function takes (spark, folder) and returns a DataFrame."""
    def add(run):
        if name in REGISTRY:
            raise ValueError(f"query {name!r} is registered twice")
        REGISTRY[name] = Query(run, sql)
        return run
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load_all() -> dict[str, Query]:
    from catalog import (  # noqa: F401  (importing fills the registry)
        cleaning, corruptions, evaluation, files, images, metrics, models, preparation, samplers, schemas,
    )
    return REGISTRY
