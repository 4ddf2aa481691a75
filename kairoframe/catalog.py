"""Every registered query and its SQL twin, by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from .adapters import World, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of a World under a name, with the SQL that gives the same rows."""

    def add(f: Callable[[World], DataFrame]) -> Callable[[World], DataFrame]:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(World(spark, sf_dir))

        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return f

    return add


from . import queries as _queries  # noqa: E402

_queries.load()
