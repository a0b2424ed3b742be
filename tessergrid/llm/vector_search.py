"""Exact top-k search by inner product with a vector-approximation file.

Each component is quantised to one of a few cells whose edges are fitted on a
bounded sample of vectors; the outermost cells are widened in every shard to what
they really hold, so bounds are right for every vector.

1. Every partition packs its vectors into shards of a bounded number of rows: the
   cells (a byte a component), what each cell spans, and the exact vectors in the
   smallest type that holds them. That is the approximation file.
2. Queries are packed into blocks of a bounded number of rows in the same way.
3. A few shards and a few blocks meet in a tile; tiles are dealt out by a shuffle. In
   a tile the cells give an upper and a lower bound of each score; exact vectors are
   then read in the order of the upper bound, until the kth best exact score lies above
   all bounds that are left. Each tile returns its k best per query; the k best of
   those are the answer.

Only the sample and the cell edges, of a bounded size, go through the driver, and the
plan is the same for any number of queries.

Defined cases: vectors that are null, empty, or hold null or non-finite components
take no part, neither do rows with a null id; a query is compared with vectors of
its own dimension; rows with the query's id are the query's own; repeated rows are
searched and found as often as they occur; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 5
SCALE = 256
CELLS = 16
#: Rows of a block of queries and of a shard of vectors, at most, and vectors on which the cells are fitted, about.
QUERY_BLOCK = 1024
SHARD_ROWS = 8192
FIT_ROWS = 4096
#: Shards and blocks of a tile, about.
GROUP = 4
#: Queries of a block that are bounded at a time.
STEP = 256


def whole_vectors(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, v): valid vectors with components floor(scale * x) as whole numbers in doubles."""
    v = F.col(vector).cast("array<double>")
    fine = F.col(vec_id).isNotNull() & v.isNotNull() & (F.size(v) > 0)
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return df.where(fine).where(finite).select(F.col(vec_id).cast("bigint").alias("id"), F.transform(v, lambda x: F.floor(x * SCALE).cast("double")).alias("v"))


def _matrix(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows of a list column by dimension: indices and a matrix of each."""
    values, off = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    size = np.diff(off)
    out = {}
    for d in np.unique(size).tolist():
        rows = np.flatnonzero(size == d)
        out[d] = rows, values[off[:-1][rows][:, None] + np.arange(d)]
    return out


def fit_cells(sample: dict[int, np.ndarray], cells: int) -> dict[int, np.ndarray]:
    """Inner cell edges (dimension x (cells - 1)) for each vector size: quantiles of the sample, per component."""
    return {d: np.quantile(m, np.arange(1, cells) / cells, axis=0).T for d, m in sample.items()}


class Approximation:
    """The cells of a shard of vectors, and what each cell spans."""

    def __init__(self, cell: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.cell, self.low, self.high = cell, low, high

    @classmethod
    def of(cls, vectors: np.ndarray, edges: np.ndarray) -> Approximation:
        n, d = vectors.shape
        cell, low, high = np.empty((n, d), np.uint8), np.empty((d, edges.shape[1] + 1)), np.empty((d, edges.shape[1] + 1))
        for j in range(d):
            cell[:, j] = np.searchsorted(edges[j], vectors[:, j], side="right")
            low[j] = np.concatenate([[vectors[:, j].min()], edges[j]])
            high[j] = np.concatenate([edges[j], [vectors[:, j].max()]])
        return cls(cell, np.minimum(low, high), np.maximum(low, high))

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest value of each component of each vector (components x vectors)."""
        at = np.arange(self.cell.shape[1])
        return self.low[at, self.cell].T, self.high[at, self.cell].T


def bounds(low: np.ndarray, high: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible score of each (query, vector), from the spans of the cells alone."""
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    slack = 1e-9 * (np.abs(plus) + np.abs(minus)) @ np.maximum(np.abs(low), np.abs(high))
    return plus @ low + minus @ high - slack, plus @ high + minus @ low + slack


def search(approximation: Approximation, vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores): each query's k best of these vectors."""
    low, high = approximation.spans()
    n = len(ids)
    for a in range(0, len(queries), STEP):
        least, most = bounds(low, high, queries[a : a + STEP])
        own = query_ids[a : a + STEP, None] == ids[None, :]
        least[own] = most[own] = -np.inf
        floor = np.partition(least, n - k, axis=1)[:, n - k] if n > k else np.full(len(least), -np.inf)
        for q in range(len(least)):
            near = np.flatnonzero((most[q] >= floor[q]) & ~own[q])
            near = near[np.argsort(-most[q, near], kind="stable")]
            best_id, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
            step = 4 * k
            for b in range(0, len(near), step):
                if len(best) >= k and best[k - 1] > most[q, near[b]]:
                    break  # certain: whatever is left scores lower
                part = near[b : b + step]
                scores = _exact(vectors[part], queries[a + q])
                both_id, both = np.concatenate([best_id, ids[part]]), np.concatenate([best, scores])
                order = np.lexsort((both_id, -both))[:k]
                best_id, best = both_id[order], both[order]
            yield a + q, best_id, best


def _exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Scores as whole numbers, exact within 64 bits."""
    return vectors.astype(np.int64) @ query.astype(np.int64)


def _lean(matrix: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds them."""
    most = np.abs(matrix).max(initial=0)
    return matrix.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.float64)


def _packed(batches: Iterator[pa.RecordBatch], rows: int, edges: dict[int, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
    """Rows (id, v) in; a row for each ``rows`` vectors of one dimension out, with their cells where there are edges."""
    names = ["d", "ids", "kind", "vectors", *(("cells", "low", "high") if edges is not None else ())]
    held: list[tuple[np.ndarray, pa.Array]] = []
    count = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal count
        ids, column = np.concatenate([x for x, _ in held]), pa.concat_arrays([v for _, v in held])
        held.clear()
        count = 0
        for d, (at, matrix) in _matrix(column).items():
            own = _lean(matrix)
            made: list = [d, ids[at].astype(np.int64).tobytes(), own.dtype.str, own.tobytes()]
            if edges is not None:
                x = Approximation.of(matrix, edges[d] if d in edges else np.zeros((d, 0)))
                made += [x.cell.tobytes(), x.low.tobytes(), x.high.tobytes()]
            kinds = {int: pa.int32(), str: pa.string(), bytes: pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array([v], kinds[type(v)]) for v in made], names)

    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            part = batch.slice(a, rows)
            if count + part.num_rows > rows:
                yield from flush()
            held.append((part.column(0).to_numpy(), pa.concat_arrays([part.column(1)])))
            count += part.num_rows
    if held:
        yield from flush()


_FOUND = pa.schema([("block", pa.int64()), ("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _tile(shards: pa.Table, blocks: pa.Table, k: int) -> pa.Table:
    """Each query's k best of each shard."""
    out = [[np.zeros(0, np.int64)] for _ in _FOUND]
    asked = blocks.to_pylist()
    for s in shards.to_pylist():
        d = s["d"]
        plain = lambda x, d=d: np.frombuffer(x["vectors"], x["kind"]).reshape(-1, d)
        cells = Approximation(np.frombuffer(s["cells"], np.uint8).reshape(-1, d), *(np.frombuffer(s[x], np.float64).reshape(d, -1) for x in ("low", "high")))
        for b in asked:
            ids = np.frombuffer(b["ids"], np.int64)
            for q, found, scores in search(cells, plain(s), np.frombuffer(s["ids"], np.int64), plain(b).astype(np.float64), ids, k):
                for column, value in zip(out, (b["block"], q, ids[q], found, scores), strict=True):
                    column.append(value if isinstance(value, np.ndarray) else np.full(len(found), value, np.int64))
    return pa.table([pa.array(np.concatenate(c).astype(np.int64)) for c in out], schema=_FOUND)


def top_k(vectors: DataFrame, is_query: Column, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, cells: int = CELLS, query_block: int = QUERY_BLOCK, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of every row of ``vectors`` for each row that is a query."""
    rows, asked = whole_vectors(vectors, vec_id, vector), whole_vectors(vectors.where(is_query), vec_id, vector)
    n_rows, n_asked = vectors.select(F.count("*"), F.count_if(is_query)).first()
    share = min(1.0, FIT_ROWS / max(n_rows, 1))
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).toArrow().column("v").combine_chunks()
    edges = fit_cells({d: m for d, (_, m) in _matrix(sample).items()} if len(sample) else {}, cells)
    shared = vectors.sparkSession.sparkContext.broadcast(edges)
    plain = "d int, ids binary, kind string, vectors binary"
    shards = rows.mapInArrow(lambda it: _packed(it, shard_rows, shared.value), f"{plain}, cells binary, low binary, high binary")
    blocks = asked.mapInArrow(lambda it: _packed(it, query_block, None), plain).withColumn("block", F.monotonically_increasing_id())
    # tiles have GROUP shards and GROUP blocks, about; every group of shards meets every group of blocks
    left, right = (max(1, -(-n // (GROUP * size))) for n, size in ((n_rows, shard_rows), (n_asked, query_block)))
    group = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tiles = ["d", "shard_group", "block_group"]
    dealt = [shards.withColumns({"shard_group": group(left)}).withColumn("block_group", every(right)), blocks.withColumns({"block_group": group(right)}).withColumn("shard_group", every(left))]
    # a repeated query is a row of its own: block and query_row tell it apart
    found = dealt[0].groupBy(*tiles).cogroup(dealt[1].groupBy(*tiles)).applyInArrow(lambda a, b: _tile(a, b, k), "block bigint, query_row bigint, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("block", "query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


__all__ = ["Approximation", "bounds", "fit_cells", "search", "top_k", "whole_vectors"]
