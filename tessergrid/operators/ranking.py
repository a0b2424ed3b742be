"""Ranking, sampling and sequence operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stored


def top_per(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; the limit is pushed below the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``name``: the place of each row in a total order, from 1, without a task that sees all rows.

    Rows are sorted by range; the sizes of the ranges, one row each, give every range its first number.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    kept = stored(ranged.withColumn("_range", F.shiftright("_at", 33)))
    sizes = kept.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.col("_at") - F.shiftleft("_range", 33)
    return kept.join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range").withColumn(name, (F.col("_before") + within + 1).cast("int")).drop("_at", "_range", "_before")


def stratified_sample(df: DataFrame, strata: list[str], key: str, seed: str, n: int, interleave: str) -> DataFrame:
    """n rows drawn round-robin from the strata, in an order fixed by a hash of the seed and the key.

    The strata take turns by ``interleave`` value; only strata, not rows, are ordered in one place.
    """
    draw = F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256)
    rounds = df.withColumn("round", F.row_number().over(Window.partitionBy(*strata).orderBy(draw, key))).where(F.col("round") <= n)
    turns = df.select(*strata).distinct().withColumn("turn", F.row_number().over(Window.partitionBy(interleave).orderBy(*strata)))
    rounds = rounds.join(turns, strata)
    return rounds.orderBy("round", "turn", *strata).limit(n)


def section_ends(df: DataFrame, parent: str, order: str, start: str, parent_end: str) -> DataFrame:
    """End of each section: where the next of the same parent starts, else where the parent ends."""
    w = Window.partitionBy(parent).orderBy(order)
    return df.withColumn("section_end", F.coalesce(F.lead(start).over(w), F.col(parent_end)))


def within_budget(df: DataFrame, group: list[str], order: list[Column], cost: Column, budget: int, most: int) -> DataFrame:
    """The longest prefix of each group that costs no more than the budget, of at most ``most`` rows."""
    w = Window.partitionBy(*group).orderBy(*order)
    spent = F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumns({"position": F.row_number().over(w), "spent": spent}).where((F.col("position") <= most) & (F.col("spent") <= budget))


def rolling(df: DataFrame, group: str, time: str, seconds: int, **aggregates: Column) -> DataFrame:
    """Aggregates over the last ``seconds`` up to each row, by microsecond."""
    w = Window.partitionBy(group).orderBy(F.unix_micros(F.col(time).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return df.select("*", *[a.over(w).alias(name) for name, a in aggregates.items()])


def interleave(df: DataFrame, group: str, group_order: Column, order: list[Column], item: str, n: int) -> DataFrame:
    """Ranked lists merged in turns: all firsts, then all seconds; an item stays where it first comes; n rows."""
    turned = df.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).withColumn("place", group_order)
    first = top_per(turned, [item], [F.col("turn"), F.col("place")], 1, "seen")
    return first.orderBy("turn", "place").limit(n).drop("seen")


def min_span(occurrences: DataFrame, doc: str, position: str, term: str, wanted: list[str]) -> DataFrame:
    """(doc, span): the least distance between the ends of a window that has all wanted terms.

    For every occurrence the latest position of each term so far closes the best window that ends there.
    """
    w = Window.partitionBy(doc).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(F.when(F.col(term) == t, F.col(position)), ignorenulls=True).over(w).alias(f"at{i}") for i, t in enumerate(wanted)]
    kept = occurrences.where(F.col(term).isin(wanted)).select(doc, position, *last)
    full = kept.where(" and ".join(f"at{i} is not null" for i in range(len(wanted))))
    start = F.least(*[F.col(f"at{i}") for i in range(len(wanted))]) if len(wanted) > 1 else F.col("at0")
    return full.groupBy(doc).agg(F.min(F.col(position) - start).alias("span"))
