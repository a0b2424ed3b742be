import pytest
from pyspark.sql import functions as F

from tessergrid.operators import identities as N
from tessergrid.operators.block_codec import block_faults, encoded_rows
from tessergrid.plans.fixtures import Fixture

_PACKED = Fixture(
    "packed",
    "set_id string, ord int, repeats int, nulls int, cells array<string>",
    (
        ("p", 1, 0, 0, ["0", "100", "AFAM", "History"]), ("p", 2, 5, 0, ["101", "Later history"]), ("p", 3, 15, 0, []), ("p", 4, 1, 2, ["EALL", "Poems"]), ("p", 5, 2, 0, ["1", "HIST", "Back"]), ("p", 6, 0, 15, []), ("p", 7, 15, 0, []), ("p", 8, 0, 8, ["1", "7", "X"]),
        ("q", 1, 4, 0, ["0", "1", "T"]), ("q", 2, 0, 0, ["9", "2", "S", "U"]),
    ),
)
SPELLED = [
    ("p", 1, "Yale", "100", "AFAM", "History"), ("p", 2, "Yale", "101", "AFAM", "Later history"), ("p", 3, "Yale", "101", "AFAM", "Later history"), ("p", 4, "Yale", None, "EALL", "Poems"),
    ("p", 5, "Brown", None, "HIST", "Back"), ("p", 6, None, None, None, None), ("p", 7, None, None, None, None), ("p", 8, "Brown", "7", "X", None), ("q", 1, "Yale", "1", None, "T"), ("q", 2, None, "2", "S", "U"),
]
COLUMNS, CODED = ["college", "number", "subject", "title"], {"college": {0: "Yale", 1: "Brown"}}


def _rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_awkward_rows(spark):
    packed = _PACKED.frame(spark)
    assert _rows(N.decoded_rows(packed, COLUMNS, CODED)) == sorted(map(repr, SPELLED))
    assert [r.set_id for r in N.faulty_sets(packed).collect()] == ["q"]
    got = {(r.set_id, r.ord): r.fault for r in block_faults(packed, COLUMNS, CODED).collect()}
    assert got == {("q", 1): "nothing to repeat", ("q", 2): "unknown code"}


def test_round_trip(spark):
    rows = [r[1:] for r in SPELLED] + [(9, "Yale", "", "", None), (10, "Yale", "", None, None), (11, None, None, None, None)]
    df = spark.createDataFrame([(r[0] + 100 * i, *r[1:]) for i in range(5) for r in rows], "k int, college string, number string, subject string, title string").dropDuplicates(["k"])
    packed = encoded_rows(df.repartition(3), F.expr("k div 7"), "k", COLUMNS, CODED)
    assert block_faults(packed, COLUMNS, CODED).count() == 0
    assert _rows(N.decoded_rows(packed, COLUMNS, CODED).drop("set_id")) == _rows(df)
    one = packed.where("set_id = 1")  # a block needs no other
    assert _rows(N.decoded_rows(one, COLUMNS, CODED).drop("set_id")) == _rows(df.where("k div 7 = 1"))
    assert packed.agg(F.sum(F.size("cells"))).first()[0] < 4 * df.count()
    assert encoded_rows(df.limit(0), F.lit(0), "k", COLUMNS, CODED).count() == 0


def test_faults(spark):
    rows = [("a", 1, 0, 0, ["0", "1", "s", "t"]), ("a", 2, 16, 0, ["0", "1", "s", "t"]), ("a", 3, 2, 2, ["0", "s", "t"]), ("a", 4, 0, 0, ["0"]), ("a", 5, 15, 0, ["0"]), ("a", 6, 0, 14, ["9"]), ("a", 7, None, 0, []), ("a", 8, -1, 0, []), ("a", 9, 0, 15, [])]
    got = {r.ord: r.fault for r in block_faults(spark.createDataFrame(rows, "set_id string, ord int, repeats int, nulls int, cells array<string>"), COLUMNS, CODED).collect()}
    assert got == {2: "mask too long", 3: "both repeated and null", 4: "too few cells", 5: "too many cells", 6: "unknown code", 7: "incomplete", 8: "mask too long"}


def test_refused(spark):
    df = spark.createDataFrame([(1, "Penn")], "k int, college string")
    with pytest.raises(Exception, match="no code for"):
        encoded_rows(df, F.lit(0), "k", ["college"], CODED).collect()
    with pytest.raises(ValueError):
        encoded_rows(df, F.lit(0), "k", [], {})
