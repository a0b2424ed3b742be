"""Fingerprints of ordered rows as trees of ranges of their keys, so that two snapshots show where they differ."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys a leaf covers, and children a node has; a node gathers as many digests at most.
FANOUT = 4096
#: Levels that 64-bit keys need.
LEVELS = 6
_LANES = (1, 16, 31, 46)


def _row_digests(df: DataFrame, group: str, key: str, value: Column) -> DataFrame:
    """(group, key, n, digest): a key's digest is that of its value, or of the multiset of its values where it has several.

    Digests of several rows are added up in four lanes of 60 bits, so that however many rows one key has, none are gathered.
    """
    digest = F.sha2(F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("null")), 256)
    lane = lambda at: F.sum(F.conv(F.substring("digest", at, 15), 16, 10).cast("decimal(38,0)"))
    several = F.sha2(F.concat_ws(",", F.count("*").cast("string"), *[lane(at).cast("string") for at in _LANES]), 256)
    rows = df.select(F.col(group).alias("group"), F.col(key).cast("bigint").alias("key"), digest.alias("digest"))
    return rows.groupBy("group", "key").agg(F.count("*").alias("n"), F.when(F.count("*") == 1, F.min("digest")).otherwise(several).alias("digest"))


def hash_tree(df: DataFrame, group: str, key: str, value: Column, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(group, level, node, n, digest): node i of level l covers the keys from i * fanout^l to before (i + 1) * fanout^l.

    A node's digest is sha256 of its children's "number:digest" in order, a line each; leaves have level 1, and the children of a
    leaf are its keys. The last level of ``levels`` has one node a sign where fanout^levels keys are not passed, which 64-bit
    keys do not with the defaults. A null key is left in a node of its own (null) on every level; null is a group too.
    Each level is a grouping of the one below, which is smaller by the keys a node covers.
    """
    below = _row_digests(df, group, key, value).withColumnRenamed("key", "node")
    made = []
    for level in range(1, levels + 1):
        child = F.struct(F.col("node").alias("at"), F.concat_ws(":", F.coalesce(F.col("node").cast("string"), F.lit("null")), "digest").alias("line"))
        # floor of an exact quotient of whole numbers: negative keys go down, as ranges do
        up = F.expr(f"node div {fanout} - if(node % {fanout} < 0, 1, 0)")
        lines = F.array_join(F.transform(F.array_sort(F.collect_list("child")), lambda c: c["line"]), "\n")
        below = below.select("group", up.alias("node"), "n", child.alias("child")).groupBy("group", "node").agg(F.sum("n").alias("n"), F.sha2(lines, 256).alias("digest"))
        made.append(below.select("group", F.lit(level).alias("level"), "node", "n", "digest"))
    return reduce(DataFrame.unionByName, made)


def differing_nodes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(group, level, node, change): nodes of two trees that are not alike: added, removed or changed from ``a`` to ``b``."""
    x, y = a.alias("x"), b.alias("y")
    on = F.col("x.group").eqNullSafe(F.col("y.group")) & (F.col("x.level") == F.col("y.level")) & F.col("x.node").eqNullSafe(F.col("y.node"))
    both = x.join(y, on, "full_outer").where(~F.col("x.digest").eqNullSafe(F.col("y.digest")))
    of = lambda c: F.when(F.col("x.digest").isNull(), F.col(f"y.{c}")).otherwise(F.col(f"x.{c}")).alias(c)
    change = F.when(F.col("x.digest").isNull(), "added").when(F.col("y.digest").isNull(), "removed").otherwise("changed")
    return both.select(of("group"), of("level"), of("node"), change.alias("change"))
