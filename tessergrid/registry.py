"""Named queries: a function over the tables of a folder and, where SQL can say the same, its oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .session import Tables


@dataclass
class Query:
    name: str
    run: Callable[[Tables], DataFrame]
    covers: tuple[str, ...]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(covers: str, sql: str | None = None) -> Callable:
    """Register a function of ``Tables`` under its own name; ``covers`` lists inventory ids."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = Query(f.__name__, f, tuple(covers.split()), sql)
        return f

    return add


def as_callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, folder, q=q: q.run(Tables(spark, folder))) for name, q in QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: q.sql for name, q in QUERIES.items() if q.sql}
