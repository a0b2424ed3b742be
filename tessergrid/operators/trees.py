"""Trees from levels: the parent and the extent of every row of an outline, however deep it is and however long its group.

Rows are sorted by range. Each range is read once with a stack of the levels that are open, which settles all but the rows that
look beyond its first row; those ask for (group, level). What is on the stack at the end of a range, at most one row a level, is
all that later ranges can see of it, so the questions are answered from these stacks alone.

A row without a group, an order or a level is nobody's parent and has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored


def _scan(batches: Iterator[pa.RecordBatch], equal: bool) -> Iterator[pa.RecordBatch]:
    """(row, group, order, level) of a range in order; out: row, group, level, at (what the row is below), asks; and at the end the stack, without rows."""
    here, first, now, stack = TaskContext.get().partitionId(), None, None, []
    schema = None
    for batch in batches:
        groups, orders, levels = (batch.column(k).to_pylist() for k in (1, 2, 3))
        at, asks = [], []
        for g, o, v in zip(groups, orders, levels, strict=True):
            if g is None or o is None or v is None:
                at.append(None)
                asks.append(False)
                continue
            if g != now:
                first, now, stack = g if first is None else first, g, []
            while stack and (stack[-1][0] > v or (stack[-1][0] == v and not equal)):
                stack.pop()
            at.append(stack[-1][1] if stack else None)
            asks.append(not stack and g == first)
            if stack and stack[-1][0] == v:
                stack.pop()
            stack.append((v, o))
        n = len(at)
        made = [batch.column(0), batch.column(1), batch.column(3), pa.array(at, pa.int64()), pa.array(asks, pa.bool_()), pa.array([here] * n, pa.int32())]
        schema = pa.schema([pa.field(f"c{k}", c.type) for k, c in enumerate(made)])
        yield pa.RecordBatch.from_arrays(made, schema=schema)
    if stack:
        n = len(stack)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, schema.field(0).type), pa.array([now] * n, schema.field(1).type), pa.array([v for v, _ in stack], schema.field(2).type), pa.array([o for _, o in stack], pa.int64()), pa.nulls(n, pa.bool_()), pa.array([here] * n, pa.int32())], schema=schema)


def nearest_lower(df: DataFrame, group: str, order: str, level: str, name: str, *, later: bool = False, equal: bool = False) -> DataFrame:
    """``df`` with ``name``: the order of the nearest earlier (``later``: later) row of the group with a lower (``equal``: or equal) level."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    way = F.desc("o") if later else F.asc("o")
    rows = df.select(F.struct(*df.columns).alias("row"), F.col(group).alias("g"), F.col(order).cast("bigint").alias("o"), F.col(level).cast("bigint").alias("v"))
    ranged = rows.repartitionByRange(parts, F.col("g"), way).sortWithinPartitions("g", way)
    fields = [T.StructField("row", rows.schema["row"].dataType), T.StructField("g", rows.schema["g"].dataType)]
    schema = T.StructType([*fields, *T._parse_datatype_string("v bigint, at bigint, asks boolean, part int")])
    made = stored(ranged.mapInArrow(lambda it: _scan(it, equal), schema))
    asked = made.where("asks").select("g", F.col("v").alias("t"), "part").distinct()
    ends = made.where("asks is null").select("g", "v", "at", "part")
    below = F.col("v") <= F.col("t") if equal else F.col("v") < F.col("t")
    last = F.min("at") if later else F.max("at")
    seen = asked.select("g", "t").distinct().join(ends, "g").where(below).groupBy("g", "t", "part").agg(last.alias("at"))
    both = seen.withColumn("kind", F.lit(1)).unionByName(asked.withColumns({"at": F.lit(None).cast("bigint"), "kind": F.lit(0)}))
    before = Window.partitionBy("g", "t").orderBy("part", "kind").rowsBetween(Window.unboundedPreceding, -1)
    told = both.withColumn("told", F.last("at", ignorenulls=True).over(before)).where("kind = 0 and told is not null").select("g", F.col("t").alias("v"), "part", "told")
    rows = made.where("asks is not null").join(told, ["g", "v", "part"], "left")
    kept = [F.col(f"row.{c}").alias(c) for c in df.columns if c != name]
    return rows.select(*kept, F.coalesce("at", "told").alias(name))


def parents(df: DataFrame, group: str, order: str, level: str) -> DataFrame:
    """parent: the nearest earlier heading of a lower level."""
    return nearest_lower(df, group, order, level, "parent")


def sections(df: DataFrame, group: str, order: str, level: str) -> DataFrame:
    """parent and ``ends``: a heading's section is all rows from its own to before ``ends`` (null: to the end of the group), so a subtree is one range."""
    return nearest_lower(parents(df, group, order, level), group, order, level, "ends", later=True, equal=True)


__all__ = ["nearest_lower", "parents", "sections"]
