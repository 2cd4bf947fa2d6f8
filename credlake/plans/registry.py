"""Query registry: name -> (Spark builder, DuckDB oracle SQL or None)."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    name: str
    ids: str
    build: Builder
    oracle: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, ids: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.

    ``ids`` names the SURVEY operators it covers; ``oracle`` is DuckDB SQL over
    the driver views (omitted for non-SQL operators: rows-only check).
    """
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, ids, fn, oracle)
        return fn
    return deco
