"""Registry of named queries: a Spark plan builder and its SQL twin.

Each query reads whole driver tables from ``sf_dir``; the SQL twin is
DuckDB text over the same tables (registered there as views) and is used
as the correctness oracle.  Queries without a SQL twin are checked by
row count and by unit tests against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
HEADLINE: list[str] = []


def query(name: str, oracle: str | None = None, headline: bool = False):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        if headline:
            HEADLINE.append(name)
        return fn
    return deco
