"""Named queries over the given tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import prepare


@dataclass(frozen=True)
class Binding:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Binding] = {}


def query(sql: str | None = None):
    """Register a function (spark, folder) -> DataFrame under its own name."""

    def add(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(prepare(spark), folder)

        REGISTRY[fn.__name__] = Binding(run, sql)
        return fn

    return add


def load() -> dict[str, Binding]:
    from . import duplicates, profiles, records, searches, streams  # noqa: F401

    return REGISTRY
