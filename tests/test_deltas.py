import glob

import pytest
from pyspark.sql import functions as F

from tessergrid.operators.deltas import FacetCounts, signed_changes

SCHEMA = "k int, tags array<string>, who string"


def _counted(rows):
    """Rows and members by brute force."""
    out = {}
    for _, tags, who in rows:
        for facet, values in (("tag", dict.fromkeys(tags or [])), ("who", [who])):
            for v in values:
                out.setdefault((facet, v), []).append(who)
    return {k: (len(v), len(set(v))) for k, v in out.items()}


def _facets(spark, folder, **more):
    return FacetCounts(spark, folder, {"tag": F.col("tags"), "who": F.col("who")}, F.col("who"), **more)


def _got(kept, batches):
    rows = kept.counts(batches).collect()
    assert len({(r.facet, r.value) for r in rows}) == len(rows)
    return {(r.facet, r.value): (r.rows, r.members) for r in rows}


def test_signed_changes(spark):
    old = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c")], "k int, v string")
    new = spark.createDataFrame([("a", 1), (None, 2), ("d", 3), (None, None)], "v string, k int")
    got = {(r.k, r.v): r.change for r in signed_changes(old, new).collect()}
    assert got == {(1, "a"): -1, (3, "c"): -1, (3, "d"): 1, (None, None): 1}
    assert signed_changes(new, new).count() == 0 and signed_changes(old.limit(0), old.limit(0)).count() == 0
    with pytest.raises(ValueError):
        signed_changes(old, new.withColumn("change", F.lit(1)))


def test_counts_follow_changes(spark, tmp_path):
    steps = [
        [(1, ["a", "b", "a"], "x"), (2, ["a"], "x"), (3, ["a", None], None), (4, None, "y"), (5, [], "y"), (5, [], "y")],
        [(1, ["a", "b", "a"], "x"), (3, ["b"], None), (4, ["c"], "y"), (5, [], "y"), (6, ["a"], "z")],
        [(6, ["a"], "z")],
        [],
        [(1, ["a"], "x")],
    ]
    kept, frames = _facets(spark, str(tmp_path), buckets=8), [spark.createDataFrame(s, SCHEMA) for s in steps]
    kept.apply(frames[0].withColumn("change", F.lit(1)), 0)
    assert _got(kept, 1) == _counted(steps[0])
    for b in range(1, len(steps)):
        for _ in range(2):  # a batch that is run again changes nothing
            kept.apply(signed_changes(frames[b - 1], frames[b]), b)
        assert _got(kept, b + 1) == _counted(steps[b]), b


def test_a_batch_reads_its_buckets_only(spark, tmp_path):
    rows = spark.range(2000).selectExpr("int(id) as k", "array(string(id % 500)) as tags", "string(id % 300) as who")
    kept = _facets(spark, str(tmp_path), buckets=64)
    kept.apply(rows.withColumn("change", F.lit(1)), 0)
    kept.apply(rows.where("k = 7").withColumn("change", F.lit(-1)), 1)
    touched = {int(p.rsplit("=", 1)[1]) for p in glob.glob(f"{tmp_path}/multiplicities/batch=000001/bucket=*")}
    assert 1 <= len(touched) <= 2
    read = kept.before(1, sorted(touched))
    assert "PartitionFilters: [isnotnull(bucket" in read._jdf.queryExecution().toString() or "PartitionFilters: [bucket" in read._jdf.queryExecution().toString()
    assert _got(kept, 2) == _counted([tuple(r) for r in rows.where("k <> 7").collect()])


def test_nothing_is_taken_away_twice(spark, tmp_path):
    kept, rows = _facets(spark, str(tmp_path)), spark.createDataFrame([(1, ["a"], "x")], SCHEMA)
    kept.apply(rows.withColumn("change", F.lit(1)), 0)
    kept.apply(rows.withColumn("change", F.lit(-2)), 1)
    with pytest.raises(Exception, match="more rows were taken away"):
        kept.counts(2).collect()
