"""Writing results: guarded CSV, JSON lines, snapshots that name themselves by content, checked copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SECRET_PATTERNS, formula_safe
from ..operators.filters import assert_empty


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as compact JSON, text safe to open as a spreadsheet."""

    def cell(f: T.StructField) -> Column:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            c = F.to_json(c)
        elif not isinstance(f.dataType, T.StringType):
            return c
        return formula_safe(c).alias(f.name)

    return df.select(*[cell(f) for f in df.schema])


def write_csv(path: str, *frames: DataFrame, mode: str = "errorifexists") -> None:
    """All frames under the union of their columns, in the order in which they first appear."""
    every = flat(frames[0])
    for df in frames[1:]:
        every = every.unionByName(flat(df), allowMissingColumns=True)
    every.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_json(path: str, df: DataFrame, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def content_id(df: DataFrame) -> str:
    """A hash of the rows that does not depend on their order or on partitions: two sums of row hashes, and the count."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    part = lambda a: F.sum(F.conv(F.substring(F.sha2(row, 256), a, 15), 16, 10).cast("decimal(38,0)"))
    made = df.agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), *[F.coalesce(part(a).cast("string"), F.lit("0")) for a in (1, 16, 31, 46)]), 256))
    return made.first()[0]


def write_snapshot(df: DataFrame, folder: str, facets: list[str]) -> str:
    """Rows and facet counts under <folder>/<content id>; writing the same rows again changes nothing. Returns the path."""
    spark = df.sparkSession
    path = f"{folder}/{content_id(df)[:24]}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target):
        # staged beside its place and then renamed, so a reader never sees a part of it
        staged = f"{path}.staged"
        df.write.mode("overwrite").parquet(f"{staged}/rows")
        counts = None
        for f in facets:
            each = df.groupBy(F.col(f).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(f).alias("facet"), "value", "n")
            counts = each if counts is None else counts.unionByName(each)
        if counts is not None:
            counts.write.mode("overwrite").parquet(f"{staged}/facets")
        fs.rename(spark._jvm.org.apache.hadoop.fs.Path(staged), target)
    return path


def checked_copy(df: DataFrame, path: str, key: str, references: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """A new copy, read back: keys unique, references sound, no row lost."""
    df.write.mode("errorifexists").parquet(path)
    back = df.sparkSession.read.parquet(path)
    assert_empty(back.groupBy(key).count().where("count > 1"), f"repeated {key}")
    for own, (other, theirs) in references.items():
        assert_empty(back.where(F.col(own).isNotNull()).join(other.select(F.col(theirs).alias(own)), own, "left_anti").select(own), f"{own} without a row")
    if back.count() != df.count():
        raise ValueError("the copy has lost rows")
    return back


def explode_books(rows: DataFrame, books: str) -> DataFrame:
    """One row a book, and one without a book for a row that has none."""
    return rows.select(*[c for c in rows.columns if c != books], F.explode_outer(books).alias("book"))


def export_public(df: DataFrame, columns: list[str], path: str) -> None:
    """Only the named columns, and only if no text in them looks like a secret."""
    kept = df.select(*columns)
    texts = [f.name for f in kept.schema if isinstance(f.dataType, T.StringType)]
    secrets = [F.col(c).rlike(p) for c in texts for k, p in SECRET_PATTERNS.items() if k in ("assigned_secret", "private_key", "aws_key")]
    for s in secrets:
        assert_empty(kept.where(s), "rows with what looks like a secret")
    kept.write.mode("errorifexists").parquet(path)
