"""Joins with rules: strictness, coverage, intervals, bands, aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import assert_empty


def strict_one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that demands equal key sets and no repeated key on either side."""
    for name, df in (("left", left), ("right", right)):
        assert_empty(df.groupBy(key).count().where("count > 1"), f"repeated {key} on the {name}")
    assert_empty(mismatches(left, right, key), f"unmatched {key}")
    return left.join(right, key)


def mismatches(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one side has."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    return a.join(b, key, "full_outer").where("l is null or r is null").select(key, F.when(F.col("l").isNull(), "right").otherwise("left").alias("side"))


def neighbours(edges: DataFrame, node: object, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges that touch a node, either way round: two equality filters, not one disjunction."""
    return edges.where(F.col(src) == F.lit(node)).unionByName(edges.where((F.col(dst) == F.lit(node)) & (F.col(src) != F.lit(node))))


def band_pairs(df: DataFrame, group: list[str], position: str, reach: int, keep: list[str]) -> DataFrame:
    """Each row with the rows of its group at most ``reach`` positions away: an equi join on the neighbouring positions."""
    near = df.select(*group, F.col(position).alias("near"), *[F.col(c).alias(f"near_{c}") for c in keep])
    wide = df.withColumn("near", F.explode(F.sequence(F.col(position) - reach, F.col(position) + reach))).where(F.col("near") != F.col(position))
    return wide.join(near, [*group, "near"])


def overlapping(df: DataFrame, group: list[str], key: str, low: str, high: str, bin_width: float) -> DataFrame:
    """Pairs of a group whose closed intervals overlap and differ, the smaller key first.

    Intervals are spread over bins, so the join is on (group, bin); a pair is kept in the first bin it shares.
    """
    bins = F.sequence(F.floor(F.col(low) / bin_width), F.floor(F.col(high) / bin_width))
    spread = df.select(*group, key, low, high, F.explode(bins).alias("bin"))
    other = spread.select(*group, "bin", *[F.col(c).alias(f"other_{c}") for c in (key, low, high)])
    first = F.floor(F.greatest(F.col(low), F.col(f"other_{low}")) / bin_width) == F.col("bin")
    meet = (F.col(low) <= F.col(f"other_{high}")) & (F.col(f"other_{low}") <= F.col(high))
    differ = (F.col(low) != F.col(f"other_{low}")) | (F.col(high) != F.col(f"other_{high}"))
    return spread.join(other, [*group, "bin"]).where((F.col(key) < F.col(f"other_{key}")) & first & meet & differ).drop("bin")


def locate(points: DataFrame, intervals: DataFrame, group: str, point: str, start: str, end: str, width: int) -> DataFrame:
    """Points with the half-open interval [start, end) of their group that holds them; intervals are at most ``width`` long."""
    binned = points.withColumn("bin", F.floor(F.col(point) / width))
    spread = intervals.withColumn("bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    return binned.join(spread, [group, "bin"]).where((F.col(start) <= F.col(point)) & (F.col(point) < F.col(end))).drop("bin")


def resolve_alias(df: DataFrame, aliases: DataFrame, name: str) -> DataFrame:
    """``df`` with entity_id: that of the alias table (normal, entity_id), or external: and a hash of the normal name."""
    normal = F.trim(F.regexp_replace(F.lower(F.col(name)), r"\s+", " "))
    known = aliases.select(F.col("normal").alias("_normal"), "entity_id").dropDuplicates(["_normal"])
    joined = df.withColumn("_normal", normal).join(known, "_normal", "left")
    return joined.withColumn("entity_id", F.coalesce("entity_id", F.concat(F.lit("external:"), F.substring(F.sha2("_normal", 256), 1, 24)))).drop("_normal")
