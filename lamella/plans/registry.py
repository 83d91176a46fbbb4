"""Named queries over the derived tables, each next to its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lamella.session import tune
from lamella.sources.derived import Tables, with_chain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None, recursive: bool = False):
    """Register ``fn(tables) -> DataFrame`` under ``name``, with its oracle SQL if given."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(tune(spark), folder))
        if sql is not None:
            text = with_chain(sql, extra)
            if recursive:
                text = text.replace("WITH ", "WITH RECURSIVE ", 1)
            ORACLES[name] = text
        return fn

    return wrap
