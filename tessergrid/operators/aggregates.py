"""Aggregations: merging sources, recurrence, hierarchical counts, label evaluation, pooling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merge_sources(df: DataFrame, key: list[str], order: str, first: list[str], union: list[str], any_true: dict[str, Column]) -> DataFrame:
    """One row a key: ``first`` columns of the earliest row, sorted distinct values of ``union`` ones, flags if any row has them."""
    return df.groupBy(*key).agg(
        *[F.min_by(c, order).alias(c) for c in first],
        *[F.array_sort(F.collect_set(c)).alias(c) for c in union],
        *[F.bool_or(test).alias(name) for name, test in any_true.items()],
        F.count("*").alias("n_sources"),
    )


def recurrence(df: DataFrame, item: str, owner: str, owner_identity: str, least: int = 2) -> DataFrame:
    """Items that at least ``least`` owners have: rows, owners, owner identities, and the scope of the recurrence."""
    # an owner counts with the first of its identities, so that rows need not be repeated for each of two distinct counts
    each = df.select(F.col(item).alias("i"), F.col(owner).alias("o"), F.col(owner_identity).alias("d")).groupBy("i", "o", "d").agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("i", "o").orderBy("d")) == 1
    named = each.withColumn("own", (first & F.col("o").isNotNull()).cast("int")).groupBy("i", "d").agg(F.sum("n").alias("n"), F.sum("own").alias("own"))
    counted = named.groupBy(F.col("i").alias(item)).agg(F.sum("n").alias("n_rows"), F.sum("own").alias("n_owners"), F.count("d").alias("n_identities"))
    return counted.where(F.col("n_owners") >= least).withColumn("scope", F.when(F.col("n_identities") > 1, "cross-identity").otherwise("same-identity"))


def precedence(found: Column, ladder: list[str]) -> Column:
    """The first status of a ladder that an array of statuses holds."""
    out = F.lit(None).cast("string")
    for status in reversed(ladder):
        out = F.when(F.array_contains(found, status), F.lit(status)).otherwise(out)
    return out


def evaluate_labels(expected: DataFrame, predicted: DataFrame, key: str, label: str) -> DataFrame:
    """Per label, and over all (label null): tp, fp, fn, precision, recall, f1; ratios without a denominator are null."""
    e = expected.select(key, label).distinct().withColumn("e", F.lit(1))
    p = predicted.select(key, label).distinct().withColumn("p", F.lit(1))
    both = e.join(p, [key, label], "full_outer")
    count = lambda test: F.count(F.when(test, 1))
    counted = both.rollup(label).agg(count(F.col("e").isNotNull() & F.col("p").isNotNull()).alias("tp"), count(F.col("e").isNull()).alias("fp"), count(F.col("p").isNull()).alias("fn"))
    ratio = lambda a, b: F.try_divide(a.cast("double"), b)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counted.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def mean_pool(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, pos, value): the element-wise mean of a group's vectors, scaled to length 1; groups of zero mean are left out.

    Aggregates per position, so nothing but sums is ever gathered.
    """
    means = df.select(group, F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x")).groupBy(group, "pos").agg(F.avg("x").alias("m"))
    norms = means.groupBy(group).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm")).where("norm > 0")
    return means.join(norms, group).select(group, "pos", (F.col("m") / F.col("norm")).alias("value"))


def consolidate(df: DataFrame, key: str, filled: list[str], prefer: Column, order: str, verified: Column) -> DataFrame:
    """One record a key: that which is preferred, then fullest, then first; whether all are verified; how many there were."""
    n_filled = sum((F.when(F.length(F.trim(F.col(c).cast("string"))) > 0, 1).otherwise(0) for c in filled), F.lit(0))
    best = F.struct(prefer.cast("int").alias("p"), n_filled.alias("f"), (-F.col(order)).alias("o"), F.struct(*filled, order).alias("record"))
    grouped = df.groupBy(key).agg(F.max(best).alias("b"), F.bool_and(verified).alias("all_verified"), F.count("*").alias("n_variants"))
    return grouped.select(key, "b.record.*", "all_verified", "n_variants")


def ordered_fingerprint(df: DataFrame, group: str, order: str, value: Column) -> DataFrame:
    """sha256 of a group's values in order: each row is hashed first, so a group gathers only digests."""
    digests = df.select(group, F.struct(F.col(order).alias("o"), F.sha2(value, 256).alias("d")).alias("x"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["d"]), "\n")
    return digests.groupBy(group).agg(F.count("*").alias("n"), F.sha2(joined, 256).alias("fingerprint"))
