import random

from tessergrid.operators import trees


def expected(rows):
    """{(group, order): (parent, ends)}"""
    out = {}
    for g, o, v in rows:
        earlier = [p for h, p, u in rows if h == g and None not in (p, u, o, v) and p < o and u < v]
        later = [p for h, p, u in rows if h == g and None not in (p, u, o, v) and p > o and u <= v]
        out[g, o] = (max(earlier, default=None), min(later, default=None)) if g is not None else (None, None)
    return out


def test_long_groups_over_many_ranges(spark):
    rng = random.Random(2)
    rows = [(1, o, rng.randint(1, 50)) for o in range(400)] + [(2, o, 400 - o) for o in range(150)] + [(3, o, o) for o in range(150)] + [(g, 5, 1) for g in range(4, 20)]
    rows += [(1, 1000, None), (None, 4, 1), (21, None, 2)]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    df = spark.createDataFrame(rows, "g int, row bigint, v int")
    for n in ("3", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            got = {(r.g, r.row): (r.parent, r.ends) for r in trees.sections(df, "g", "row", "v").collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        assert got == expected(rows)


def test_empty(spark):
    none = spark.createDataFrame([], "g int, o bigint, v int")
    assert trees.sections(none, "g", "o", "v").columns == ["g", "o", "v", "parent", "ends"] and trees.parents(none, "g", "o", "v").count() == 0
