import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessergrid.llm import vector_search as V


def brute(rows, k=5):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(b) == len(a))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "shard"), [(1024, 8192), (3, 7)])
def test_brute_force_with_ties(spark, block, shard):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.integers(-3, 4, 6) / 4]) for i in range(400)]
    rows += [(1000, None), (1050, []), (1100, [float("nan")] * 6), (1150, [None] * 6), (None, [1.0] * 6), (1200, [0.5, 0.25]), (1201, [0.5, -0.25]), (7, rows[7][1]), (1250, [float("inf")] * 6)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<float>, score string, rank int").repartition(4)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in V.top_k(df, F.col("vec_id") % 50 == 0, query_block=block, shard_rows=shard).collect())
    assert got == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert V.top_k(df, F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(3)
    v, q = rng.normal(0, 80, (500, 8)).round(), rng.normal(0, 80, (20, 8)).round()
    low, high = V.bounds(*V.Approximation.of(v, V.fit_cells({8: v[:50]}, 16)[8]).spans(), q)
    exact = q @ v.T
    assert (low <= exact).all() and (exact <= high).all()


def test_sql(same):
    same("op5_vector_search")


def test_plan_does_not_grow_with_the_queries(spark):
    df = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(300)], "vec_id bigint, embedding array<float>")
    plans = [V.top_k(df, F.col("vec_id") % n == 0, query_block=2)._jdf.queryExecution().analyzed().toString().count("\n") for n in (100, 1)]
    assert plans[0] == plans[1]


def test_large_components_stay_exact(spark):
    rows = [(0, [3e6, 1.0]), (1, [2e6, -1.0]), (2, [1.0, 9.5e6]), (50, [0.5, 0.25])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in V.top_k(df, F.col("vec_id") % 50 == 0).collect()) == brute(rows)
