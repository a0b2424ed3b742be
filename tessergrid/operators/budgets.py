"""Texts of a group cut until they fit a number of bytes: the longest is halved first, rows go from the end last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stored

#: A length below 2^31 is halved fewer times.
_HALVINGS = 31


def _free(df: DataFrame, *names: str) -> list[str]:
    """The names, longer by as many underscores as no column of ``df`` begins with."""
    taken = {c.lower() for c in df.columns}
    while any(n.lower() in taken for n in names):
        names = tuple(f"_{n}" for n in names)
    return list(names)


def running_totals(df: DataFrame, group: str, order: list[Column], cost: str, name: str) -> DataFrame:
    """``name``: what the rows of a group up to and with each row cost together; no task sees a whole group.

    Rows are sorted by range; within a range totals are a window, and the sums of a group's earlier ranges, a row a range,
    are added. Rows that are equal in ``order`` share a range, so the order should tell rows apart. Null is a group too.
    """
    range_, own, before, of = _free(df, "range_", "own_", "before_", "of_")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = stored(df.repartitionByRange(parts, F.col(group), *order).withColumn(range_, F.spark_partition_id()))
    within = kept.withColumn(own, F.sum(cost).over(Window.partitionBy(range_, group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    sums = kept.groupBy(F.col(group).alias(of), F.col(range_).alias(f"{range_}s")).agg(F.sum(cost).alias(before))
    earlier = F.coalesce(F.sum(before).over(Window.partitionBy(of).orderBy(f"{range_}s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn(before, earlier)
    both = within.join(sums, within[group].eqNullSafe(sums[of]) & (within[range_] == sums[f"{range_}s"]))
    return both.withColumn(name, F.col(own) + F.col(before)).select(*df.columns, name)


def cut_to_budget(df: DataFrame, group: str, order: str, text: str, budget: int, least: int = 200) -> DataFrame:
    """The rows of each group with texts that together have at most ``budget`` UTF-8 bytes, and ``halvings`` of each.

    While a group is over the budget, its longest text by characters, of several the first in order, is cut to half its
    characters, rounded down, but not below ``least``; when none is longer than ``least``, rows go from the end. The cuts of a
    text have ever smaller lengths, so what is cut, and how often, is a prefix of all possible cuts of the group by length:
    as many as a running total of the saved bytes says. A null text has no bytes and stays. Rows that are equal in ``order``
    stand in an order that is not defined; a column named halvings is replaced.
    """
    row, size, length, of, need = _free(df, "row_", "size_", "length_", "of_", "need_")
    df = df.drop("halvings")
    rows = stored(df.withColumns({row: F.monotonically_increasing_id(), size: F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint"), length: F.coalesce(F.length(text), F.lit(0))}))
    over = rows.groupBy(F.col(group).alias(of)).agg((F.sum(size) - budget).alias(need)).where(F.col(need) > 0)
    long = rows.where(F.col(length) > least).join(over, F.col(group).eqNullSafe(F.col(of)))
    # a length before its j-th cut is length / 2^j, rounded down, as long as that is above the least one
    lengths = F.filter(F.transform(F.sequence(F.lit(0), F.lit(_HALVINGS - 1)), lambda j: F.floor(F.col(length) / F.pow(F.lit(2), j)).cast("int")), lambda n: n > least)
    octets = lambda n: F.octet_length(F.left(F.col(text), n))
    cuts = F.transform(lengths, lambda n: F.struct(n.alias("length"), (octets(n) - octets(F.greatest(F.floor(n / 2).cast("int"), F.lit(least)))).cast("bigint").alias("saved")))
    steps = long.select(F.col(of).alias("group"), F.col(order).alias("at"), F.col(row).alias("row"), F.col(need).alias("need"), F.explode(cuts).alias("cut")).select("group", "at", "row", "need", "cut.*")
    totals = running_totals(steps, "group", [F.desc("length"), F.asc("at"), F.asc("row")], "saved", "together")
    made = totals.where(F.col("together") - F.col("saved") < F.col("need")).groupBy(F.col("row").alias(of)).agg(F.count("*").cast("int").alias("halvings"))
    told = rows.join(made, rows[row] == made[of], "left").drop(of).withColumn("halvings", F.coalesce("halvings", F.lit(0)))
    short = F.greatest(F.floor(F.col(length) / F.pow(F.lit(2), F.col("halvings"))).cast("int"), F.lit(least))
    told = told.withColumn(text, F.when(F.col("halvings") > 0, F.left(F.col(text), short)).otherwise(F.col(text)))
    left = told.withColumn(size, F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint"))
    return running_totals(left, group, [F.asc(order), F.asc(row)], size, need).where(F.col(need) <= budget).select(*df.columns, "halvings")
