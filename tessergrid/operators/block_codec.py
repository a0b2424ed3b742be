"""Tables packed in blocks of rows: what a row has in common with the one before is a bit, what is null another.

A packed row is (set_id, ord, repeats, nulls, cells): bit i of ``repeats`` says that column i is as in the row before, of ``nulls``
that it is null; the other columns are the cells, in order, those of a ``coded`` column as indices into its values. The first row
of a block repeats nothing, so each block is decoded alone (``identities.decoded_rows``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bits of a mask, and so the most columns.
MOST_COLUMNS = 31


def encoded_rows(df: DataFrame, block: Column, order: str, columns: list[str], coded: dict[str, dict[int, str]]) -> DataFrame:
    """The packed rows of ``df``: ``block`` says which block a row is in, ``order`` (unique in it) its place.

    A block is sorted in one task, so ``block`` should bound its rows, as a range of keys does. Cells are strings; an empty
    string is a cell, not a null. A value that a coded column's table lacks raises.
    """
    if not 0 < len(columns) <= MOST_COLUMNS:
        raise ValueError(f"a block has 1 to {MOST_COLUMNS} columns")
    w = Window.partitionBy("set_id").orderBy("ord")
    rows = df.select(block.alias("set_id"), F.col(order).alias("ord"), F.struct(*[F.col(c).cast("string").alias(f"v{i}") for i, c in enumerate(columns)]).alias("row"))
    rows = rows.withColumn("was", F.lag("row").over(w))
    value = [F.col(f"row.v{i}") for i in range(len(columns))]
    again = [F.col("was").isNotNull() & F.col(f"was.v{i}").eqNullSafe(v) for i, v in enumerate(value)]
    bits = lambda tests: sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))

    def cell(name: str, v: Column) -> Column:
        if name not in coded:
            return v
        index = F.element_at(F.create_map(*[F.lit(x) for k, said in coded[name].items() for x in (said, str(k))]), v)
        return F.coalesce(index, F.raise_error(F.concat(F.lit(f"{name} has no code for "), v)).cast("string"))

    cells = [F.when(~t & v.isNotNull(), F.struct(cell(n, v).alias("cell"))) for n, v, t in zip(columns, value, again, strict=True)]
    packed = F.transform(F.filter(F.array(*cells), lambda c: c.isNotNull()), lambda c: c["cell"])
    return rows.select("set_id", "ord", bits(again).alias("repeats"), bits([~t & v.isNull() for t, v in zip(again, value, strict=True)]).alias("nulls"), packed.alias("cells"))


def block_faults(rows: DataFrame, columns: list[str], coded: dict[str, dict[int, str]]) -> DataFrame:
    """(set_id, ord, fault): packed rows that cannot be decoded, and the first reason why."""
    n = len(columns)
    first = F.row_number().over(Window.partitionBy("set_id").orderBy("ord")) == 1
    both = F.col("repeats").bitwiseOR(F.col("nulls"))
    unknown = F.lit(False)
    for i, name in enumerate(columns):
        if name in coded:
            below = F.bit_count(both.bitwiseAND(F.lit((1 << i) - 1)))
            index = F.get("cells", F.lit(i) - below).try_cast("int")
            unknown = unknown | ((both.bitwiseAND(F.lit(1 << i)) == 0) & ~F.coalesce(index.isin(*coded[name]), F.lit(False)))
    fault = (
        F.when(F.col("repeats").isNull() | F.col("nulls").isNull() | F.col("cells").isNull(), "incomplete")
        .when((both < 0) | (both >= 1 << n), "mask too long")
        .when(F.col("repeats").bitwiseAND(F.col("nulls")) != 0, "both repeated and null")
        .when(first & (F.col("repeats") != 0), "nothing to repeat")
        .when(F.size("cells") < F.lit(n) - F.bit_count(both), "too few cells")
        .when(F.size("cells") > F.lit(n) - F.bit_count(both), "too many cells")
        .when(unknown, "unknown code")
    )
    return rows.select("set_id", "ord", fault.alias("fault")).where("fault is not null")
