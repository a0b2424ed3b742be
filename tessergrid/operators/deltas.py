"""Counts that follow signed changes: what was added and taken away is counted, unchanged rows are not read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_GROUP = ["facet", "value", "member"]
_N, _BUCKET = "n", "bucket"


def signed_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows that lead from ``old`` to ``new`` and how often each is added (positive) or taken away (negative).

    Both are multisets: a row that is there twice and then once is taken away once. Nulls equal each other; columns are those
    of ``new``, which may not have one named ``change``. Rows are compared whole, in one shuffle with partial sums.
    """
    if "change" in new.columns:
        raise ValueError("a column is named change already")
    signed = new.withColumn("change", F.lit(1).cast("bigint")).unionByName(old.select(*new.columns).withColumn("change", F.lit(-1).cast("bigint")))
    return signed.groupBy(*new.columns).agg(F.sum("change").alias("change")).where("change <> 0")


def _named(facet: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(facet).alias("facet"), v.alias("value")))


class FacetCounts:
    """Rows and distinct members of every value of some facets, kept current by batches of signed changes.

    ``facets`` names what is counted by, ``member`` what is counted once. A folder holds, a batch each, the signed multiplicities of
    (facet, value, member) by bucket of hash, and what they did to the counts. A batch reads earlier multiplicities only of the
    buckets its changes fall into; a member leaves the distinct count when its last row goes and enters it with its first. A
    batch that runs again replaces what it left; batches after it must be run again too. Null values and null members are
    values like others. Counts below zero mean that something was taken away that was never there, and raise when read.
    """

    def __init__(self, spark: SparkSession, folder: str, facets: dict[str, Column], member: Column, buckets: int = 256):
        self.spark, self.folder, self.facets, self.member, self.buckets = spark, folder, facets, member, buckets

    def _multiplicities(self, changes: DataFrame) -> DataFrame:
        """(facet, value, member, n, bucket); a facet of arrays counts each of its distinct items."""
        kinds = changes.select(*[c.alias(f) for f, c in self.facets.items()]).dtypes
        parts = []
        for (name, kind), c in zip(kinds, self.facets.values(), strict=True):
            values = F.array_distinct(c.cast("array<string>")) if kind.startswith("array") else F.array(c.cast("string"))
            parts.append(_named(name, F.coalesce(values, F.array().cast("array<string>"))))
        each = changes.select(F.explode(F.concat(*parts)).alias("f"), self.member.cast("string").alias("member"), "change")
        summed = each.groupBy("f.facet", "f.value", "member").agg(F.sum("change").alias(_N)).where(f"{_N} <> 0")
        return summed.withColumn(_BUCKET, F.pmod(F.xxhash64(*_GROUP), F.lit(self.buckets)).cast("int"))

    def _state(self, batch: int) -> str:
        return f"{self.folder}/multiplicities/batch={batch:06d}"

    def _counts(self, batch: int) -> str:
        return f"{self.folder}/counts/batch={batch:06d}"

    def before(self, batch: int, buckets: list[int]) -> DataFrame:
        """Multiplicities before a batch, of some buckets: only their folders are opened."""
        held = [self.spark.read.schema("facet string, value string, member string, n bigint, bucket int").parquet(self._state(b)) for b in range(batch)]
        rows = held[0]
        for h in held[1:]:
            rows = rows.unionByName(h)
        return rows.where(F.col(_BUCKET).isin(buckets)).groupBy(*_GROUP).agg(F.sum(_N).alias("was"))

    def apply(self, changes: DataFrame, batch: int) -> None:
        """Count batch ``batch`` (0, 1, ..) of rows with a signed ``change``."""
        # a task a bucket writes one file; a bucket holds a share of hashes, whatever the sizes of facets and values
        self._multiplicities(changes).repartition(_BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(self._state(batch))
        mine = self.spark.read.schema("facet string, value string, member string, n bigint, bucket int").parquet(self._state(batch))
        if batch:
            touched = [r[0] for r in mine.select(_BUCKET).distinct().collect()]  # at most ``buckets`` numbers
            was = self.before(batch, touched).alias("w")
            same = [F.col(f"m.{c}").eqNullSafe(F.col(f"w.{c}")) for c in _GROUP]
            both = mine.alias("m").join(was, same, "left").select(*[f"m.{c}" for c in _GROUP], _N, F.coalesce("was", F.lit(0)).alias("was"))
        else:
            both = mine.select(*_GROUP, _N, F.lit(0).cast("bigint").alias("was"))
        there = lambda c: (c > 0).cast("bigint")
        moved = both.groupBy("facet", "value").agg(
            F.sum(_N).alias("rows"),
            F.sum(there(F.col("was") + F.col(_N)) - there(F.col("was"))).alias("members"),
            F.min(F.col("was") + F.col(_N)).alias("least"),
        )
        moved.write.mode("overwrite").parquet(self._counts(batch))

    def counts(self, batches: int) -> DataFrame:
        """(facet, value, rows, members) after the first ``batches`` batches; values without rows are left out."""
        read = self.spark.read.schema("facet string, value string, rows bigint, members bigint, least bigint").parquet(*[self._counts(b) for b in range(batches)])
        short = F.raise_error(F.concat(F.lit("more rows were taken away than there were: "), F.col("facet")))
        checked = read.withColumn("rows", F.when(F.col("least") < 0, short.cast("bigint")).otherwise(F.col("rows")))
        return checked.groupBy("facet", "value").agg(F.sum("rows").alias("rows"), F.sum("members").alias("members")).where("rows <> 0")
