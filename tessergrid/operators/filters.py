"""Filters, projections and validators on DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contains_all(df: DataFrame, needles: dict[str, str | None]) -> DataFrame:
    """Rows whose columns contain their needles, ignoring case; a needle of None asks for nothing."""
    tests = [F.contains(F.lower(F.col(c)), F.lit(v.lower())) for c, v in needles.items() if v is not None]
    return df.where(reduce(Column.__and__, tests, F.lit(True)))


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows offset .. offset + limit of an ordered result, with the total; nothing but the total is kept of other rows."""
    if not 0 < limit <= 100:
        raise ValueError("a page has 1 to 100 rows")
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))


def active(df: DataFrame, inactive: DataFrame, key: str) -> DataFrame:
    return df.join(inactive.select(key), key, "left_anti")


def unpivot(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, text): a row for each non-blank field of each row."""
    long = df.select(key, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot(key, fields, "field", "text")
    return long.where("trim(text) <> ''")


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for every rule a row breaks; a rule that is null is broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in sorted(rules.items())]))
    return df.select(key, F.explode(broken).alias("rule"))


def assert_empty(df: DataFrame, what: str) -> None:
    """Raise, naming some of the rows, unless there are none."""
    if rows := df.limit(5).collect():
        raise ValueError(f"{what}: {[r.asDict() for r in rows]}")
