"""k nearest neighbours as a graph, block against block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import top_per

#: Rows multiplied at a time, and vectors of a group that stay together; pairs held by a task before they are cut to k a group.
STRIP, HELD = 256, 1 << 20


def _best(scores: np.ndarray, left: np.ndarray, right: np.ndarray, k: int) -> list[np.ndarray]:
    """(left, right, score) of the k best of each row by rounded score, then the smaller ``right``; only positive scores."""
    scores = np.where((scores > 0) & (left[:, None] != right[None, :]), scores, -1.0)
    near = np.round(scores, 9)
    least = np.partition(near, len(right) - k, axis=1)[:, len(right) - k, None] if len(right) > k else -1.0
    i, j = np.nonzero((near >= least) & (scores > 0))
    return _cut(left[i], right[j], scores[i, j], k)


def _cut(left: np.ndarray, right: np.ndarray, score: np.ndarray, k: int) -> list[np.ndarray]:
    """The k best of each ``left``."""
    order = np.lexsort((right, -np.round(score, 9), left))
    left = left[order]
    kept = np.arange(len(left)) - np.searchsorted(left, left) < k
    return [left[kept], right[order][kept], score[order][kept]]


def knn_graph(df: DataFrame, key: str, group: str, vector: str, k: int = 3, blocks: int | None = None, rows_per_block: int = 16384) -> DataFrame:
    """(left, right, score): for each group of vectors its k most similar other groups, by the best pair of vectors.

    Vectors are dealt into blocks of about ``rows_per_block``, by group, and groups beyond ``STRIP`` vectors in parts; every two
    blocks meet once, in one task, as two matrices that answer both ways from one product, a strip at a time. Of a product the
    best pair of each two groups is kept, and of those k a group, so what is shuffled is linear in the number of block pairs.
    Scores are cosines over 0 of vectors of one dimension; ties go to the smaller id. Zero and non-finite vectors take no part.

    All pairs are compared, so time grows with the square of the vectors; memory is bounded and block pairs are spread.
    """
    v = F.col(vector).cast("array<double>")
    rows = df.where(v.isNotNull() & (F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x) > 0) & ~F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))))
    if blocks is None:
        n = rows.count()
        # small tables are cut finer, so that there are tasks for all cores
        blocks = max(1, -(-n // rows_per_block), min(8, n // 1024))
    large = rows.groupBy(F.col(group).alias("_large")).agg(F.count("*").alias("_n")).where(F.col("_n") > STRIP)
    rows = rows.join(large, F.col(group) == F.col("_large"), "left")
    part = F.when(F.col("_n").isNotNull(), F.pmod(F.xxhash64(key), F.ceil(F.col("_n") / STRIP))).otherwise(0)
    own = F.pmod(F.xxhash64(group, part), F.lit(blocks)).cast("int")
    # vectors move in their own type and become doubles in the task
    rows = rows.select(F.col(group).cast("bigint").alias("grp"), F.col(vector).alias("v"), F.size(vector).alias("d"), own.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    dealt = rows.select(F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "grp", "d", "v")

    def meet(table: pa.Table) -> pa.Table:
        block, grp = table.column("block").to_numpy(), table.column("grp").to_numpy()
        m = table.column("v").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(block), -1)
        m /= np.sqrt((m * m).sum(1, keepdims=True))
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()

        def side(x: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            at = np.flatnonzero(block == x)
            at = at[np.argsort(grp[at], kind="stable")]
            names, starts = np.unique(grp[at], return_index=True)
            return m[at], names, starts

        (x, x_names, x_starts), (y, y_names, y_starts) = side(a), side(b)
        out: list[list[np.ndarray]] = []
        back: list[list[np.ndarray]] = []  # of each right group, k a strip
        if len(x) and len(y):
            ends = np.append(x_starts[1:], len(x))
            at = 0
            while at < len(x_names):  # a strip of whole groups, of about STRIP rows; a large group comes in several
                last = max(at + 1, int(np.searchsorted(ends, x_starts[at] + STRIP, side="right")))
                best = np.full((last - at, len(y_names)), -1.0)
                for i in range(int(x_starts[at]), int(ends[last - 1]), STRIP):
                    j = min(i + STRIP, int(ends[last - 1]))
                    by_right = np.maximum.reduceat(x[i:j] @ y.T, y_starts, axis=1)
                    if last - at == 1:
                        np.maximum(best[0], by_right.max(0), out=best[0])
                    else:
                        best = np.maximum.reduceat(by_right, x_starts[at:last] - i, axis=0)
                out.append(_best(best, x_names[at:last], y_names, k))
                if a != b:
                    back.append(_best(best.T, y_names, x_names[at:last], k))
                    if sum(len(c[0]) for c in back) > HELD:
                        back = [_cut(*map(np.concatenate, zip(*back, strict=True)), k)]
                at = last
        if back:
            out.append(_cut(*map(np.concatenate, zip(*back, strict=True)), k))
        left, right, score = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"left": pa.array(left, pa.int64()), "right": pa.array(right, pa.int64()), "score": pa.array(score, pa.float64())})

    pairs = blocks * (blocks + 1) // 2
    # a number of our own, since tasks cost the product of two blocks, whatever their bytes
    found = dealt.repartition(min(2000, 2 * pairs), "a", "b", "d").groupBy("a", "b", "d").applyInArrow(meet, "left bigint, right bigint, score double")
    linked = found.groupBy("left", "right").agg(F.max("score").alias("score"))
    return top_per(linked, ["left"], [F.round("score", 9).desc(), F.col("right")], k)


__all__ = ["knn_graph"]
