import random

import pytest
from pyspark.sql import functions as F

from tessergrid.operators.budgets import cut_to_budget, running_totals


def _loop(rows, budget, least):
    """One group by the rule as it is told: [(order, text)] in order."""
    rows, cuts = [list(r) for r in rows], [0] * len(rows)
    size = lambda: sum(len((t or "").encode()) for _, t in rows)
    while size() > budget:
        i = max(range(len(rows)), key=lambda i: len(rows[i][1] or ""))
        if len(rows[i][1] or "") > least:
            rows[i][1] = rows[i][1][: max(least, len(rows[i][1]) // 2)]
            cuts[i] += 1
        else:
            rows.pop()
    return [(k, t, c) for (k, t), c in zip(rows, cuts)]


@pytest.mark.parametrize("budget", [0, 35, 300, 2000, 10**6])
def test_as_the_loop(spark, budget):
    draw = random.Random(budget)
    groups = {g: [(k, draw.choice([None, "", "é" * draw.randint(0, 300), "ab" * draw.randint(0, 40), "x" * 96, "x" * 96, "👍" * 11])) for k in range(draw.randint(1, 60))] for g in ("a", "b", None)}
    groups["long"] = [(0, "y" * 1_000_000)]
    rows = [(g, k, t, k) for g, texts in groups.items() for k, t in texts]
    df = spark.createDataFrame(rows, "g string, k int, t string, need_ int").repartition(5)
    got = {}
    for r in cut_to_budget(df, "g", "k", "t", budget, least=10).collect():
        assert r.need_ == r.k
        got.setdefault(r.g, []).append((r.k, r.t, r.halvings))
    for g, texts in groups.items():
        assert sorted(got.get(g, [])) == _loop(texts, budget, 10), g


def test_empty_and_equal_rows(spark):
    empty = spark.createDataFrame([], "g string, k int, t string")
    assert cut_to_budget(empty, "g", "k", "t", 10).count() == 0
    same = spark.createDataFrame([("a", 1, "x" * 50)] * 3, "g string, k int, t string")
    got = cut_to_budget(same, "g", "k", "t", 120, least=20).collect()
    assert sorted(len(r.t) for r in got) == [25, 25, 50] and sorted(r.halvings for r in got) == [0, 1, 1]


def test_running_totals_of_a_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 40).cast("string")).alias("g"), "id", F.lit(2).alias("c"))
    got = running_totals(df, "g", [F.desc("id")], "c", "total").where("g = 'hot'").orderBy(F.desc("id")).collect()
    assert [r.total for r in got] == [2 * (i + 1) for i in range(len(got))] and len(got) == 1667
