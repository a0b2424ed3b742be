"""Inputs of rules: a SELECT over the given tables for queries, a table of awkward rows for their tests."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Tables
from .fixtures import SQL_TYPES, Fixture, sql_value

_TABLE = re.compile(r"\{(\w+)\}")


@dataclass(frozen=True)
class AwkwardRows:
    """Stands where ``Tables`` does: inputs are their awkward rows."""

    spark: SparkSession


class Digested(Tables):
    """The tables with the md5 of each document's text in its place, for what only compares whole texts or their fingerprints."""

    @property
    def documents(self) -> DataFrame:
        return self.__getattr__("documents").withColumn("text", F.md5("text"))

    @staticmethod
    def of(t: Tables | AwkwardRows) -> Digested | AwkwardRows:
        return t if isinstance(t, AwkwardRows) else Digested(t.spark, t.folder)


@dataclass(frozen=True)
class Bound:
    """``select`` is SQL that both engines read, with tables in braces; ``rows`` has its name and types."""

    rows: Fixture
    select: str

    def frame(self, t: Tables | AwkwardRows) -> DataFrame:
        if isinstance(t, AwkwardRows):
            return self.rows.frame(t.spark)
        made = t.spark.sql(self.select, **{n: getattr(t, n) for n in set(_TABLE.findall(self.select))})
        return made.select([made[n].cast("timestamp_ntz" if k == "timestamp" else k).alias(n) for n, k in self.rows.columns])

    @property
    def sql(self) -> str:
        """``name AS (SELECT ...)``, for a WITH clause."""
        typed = ", ".join(f'"{n}"::{SQL_TYPES[k]} AS "{n}"' for n, k in self.rows.columns)
        return f"{self.rows.name} AS (SELECT {typed} FROM ({_TABLE.sub(lambda m: m[1], self.select).replace('element_at(', 'list_extract(')}))"

    @property
    def awkward_sql(self) -> str:
        return self.rows.sql


@dataclass(frozen=True)
class Clause:
    """SQL of a query that says something else over awkward rows."""

    sql: str
    awkward_sql: str


@dataclass(frozen=True)
class Words:
    """What a query asks for: words of the given texts, and others for awkward rows."""

    given: tuple[str, ...]
    awkward: tuple[str, ...]

    def of(self, t: Tables | AwkwardRows) -> list[str]:
        return list(self.awkward if isinstance(t, AwkwardRows) else self.given)

    @property
    def sql(self) -> str:
        return ", ".join(map(sql_value, self.given))

    @property
    def awkward_sql(self) -> str:
        return ", ".join(map(sql_value, self.awkward))

    @property
    def pattern(self) -> str:
        return "|".join(self.given)


def on_rows(sql: str, *inputs: Bound | Clause | Words) -> str:
    """The SQL of a query over awkward rows; what holds others is replaced before them."""
    for b in sorted(inputs, key=lambda b: -len(b.sql)):
        sql = sql.replace(b.sql, b.awkward_sql)
        if isinstance(b, Words):
            sql = sql.replace(f"({b.pattern})", f"({'|'.join(b.awkward)})")
    return sql
