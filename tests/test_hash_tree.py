import hashlib

from pyspark.sql import functions as F

from tessergrid.operators.hash_tree import differing_nodes, hash_tree

SCHEMA = "g string, k bigint, v string"


def _tree(df, **more):
    return hash_tree(df, "g", "k", F.col("v"), **more)


def _root(df):
    return {r.group: r.digest for r in _tree(df, fanout=4, levels=5).where("level = 5 and node is not null and node >= 0").collect()}


def test_by_hand(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    df = spark.createDataFrame([("a", 5, "x"), ("a", 0, None), ("a", -1, "m"), (None, 2, "=")], SCHEMA)
    got = {(r.group, r.level, r.node): (r.n, r.digest) for r in _tree(df, fanout=4, levels=2).collect()}
    low, high, neg = sha("0:" + sha("null")), sha("5:" + sha("=x")), sha("-1:" + sha("=m"))
    assert got[("a", 1, 0)] == (1, low) and got[("a", 1, 1)] == (1, high) and got[("a", 1, -1)] == (1, neg)
    assert got[("a", 2, 0)] == (2, sha(f"0:{low}\n1:{high}")) and got[("a", 2, -1)] == (1, sha(f"-1:{neg}"))
    assert got[(None, 2, 0)] == (1, sha("0:" + sha("2:" + sha("=="))))
    assert len(got) == 7 and _tree(df.limit(0)).count() == 0


def test_order_of_rows_does_not_count_but_copies_do(spark):
    rows = [("a", i % 90, f"v{i}") for i in range(300)] + [("a", None, "n"), ("a", None, "m")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert _root(df) == _root(spark.createDataFrame(rows[::-1], SCHEMA).repartition(7))
    assert _root(df) != _root(spark.createDataFrame([*rows, rows[0]], SCHEMA))
    assert _root(df) != _root(spark.createDataFrame([*rows[:-3], ("a", 299 % 90, "other")], SCHEMA))


def test_one_change_shows_one_way_down(spark):
    old = spark.range(10_000).select(F.lit("a").alias("g"), F.col("id").alias("k"), F.col("id").cast("string").alias("v"))
    new = old.withColumn("v", F.when(F.col("k") == 4321, "new").otherwise(F.col("v"))).where("k <> 9999").union(spark.createDataFrame([("b", 7, "x")], SCHEMA))
    got = {(r.group, r.level, r.node, r.change) for r in differing_nodes(_tree(old, fanout=32, levels=3), _tree(new, fanout=32, levels=3)).collect()}
    ways = {("a", n, k // 32**n, "changed") for n in (1, 2, 3) for k in (4321, 9999)} | {("b", n, 0, "added") for n in (1, 2, 3)}
    assert got == ways
    assert differing_nodes(_tree(old), _tree(old.repartition(3))).count() == 0


def test_largest_keys_have_one_root_a_sign(spark):
    df = spark.createDataFrame([("a", 2**63 - 1, "x"), ("a", -(2**63), "y"), ("a", 0, "z")], SCHEMA)
    assert sorted(r.node for r in _tree(df).where("level = 6").collect()) == [-1, 0]
