"""Vectorised byte-level text primitives shared by the operators of this subpackage.

Texts are handled as the UTF-8 bytes of an Arrow string column, so a batch of
documents is one ``uint8`` array plus offsets and never a list of Python strings.
"""

from __future__ import annotations

import ctypes
import gc
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of text handled at a time inside one Arrow batch; a longer document is a slice of its own.
SLICE_BYTES = 4 << 20

MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BYTE_CODE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LIBC = ctypes.CDLL(None)
#: Bytes of words: digits, ASCII letters and every byte of a non-ASCII character.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = True
WORD[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about ``most`` bytes each that together cover all rows."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def give_back() -> None:
    """Hand freed memory to the system: Python workers outlive their tasks, and what they hold counts against the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_LIBC, "malloc_trim", None)  # only glibc keeps what it could return, and only it has this
    if trim is not None:
        trim(0)


def spans(mask: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values; runs are also cut at the offsets ``cuts``."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    inner = cuts[(cuts > 0) & (cuts < n)]
    first[inner] = mask[inner]
    starts = np.flatnonzero(first)
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    last[inner - 1] = mask[inner - 1]
    return starts, np.flatnonzero(last) + 1


class Words:
    """The words of a slice of documents: places in the bytes, row of each, 64-bit hash.

    Words are runs of ASCII letters, digits and non-ASCII characters, with A-Z lower-cased.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.low = LOWER[raw]
        self.offsets = offsets
        self.start, self.end = spans(WORD[raw], offsets)
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        self.hash = range_hash(self.low, self.start, self.end)
        #: words[first[r]:first[r+1]] are those of row r
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)


def range_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each non-empty, ascending, disjoint range of bytes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    power = np.ones(int(size.max()), np.uint64)
    np.multiply.accumulate(np.full(len(power) - 1, MULT), out=power[1:])
    edge = np.cumsum(size) - size
    place = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(edge, size)
    at = place + np.repeat(start, size)
    sums = np.add.reduceat(BYTE_CODE[data[at]] * power[place], edge)
    return mix(sums + size.astype(np.uint64) * _MIX2)


def ngram_hash(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of n words within a row, and the index of its first word."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(words.row[:m] == words.row[n - 1 :])
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = out * MULT + words.hash[at + k]
    return mix(out), at


def append_columns(df: DataFrame, text: str, fn: Callable[[pa.Array], list[pa.Array]], fields: str) -> DataFrame:
    """``df`` plus the columns that ``fn`` makes of the column ``text``, row for row, without a shuffle.

    New columns replace those of the same name. ``fields`` is a DDL string.
    """
    new = T._parse_datatype_string(fields)
    keep = [c for c in df.columns if c not in new.names or c == text]
    df = df.select(*keep)
    drop = text in new.names
    schema = T.StructType([f for f in df.schema if not (drop and f.name == text)] + list(new))
    types = [to_arrow_type(f.dataType) for f in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            made = fn(batch.column(batch.schema.get_field_index(text)))
            old = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if not (drop and n == text)]
            made = [m if m.type == t else m.cast(t) for m, t in zip(made, types, strict=True)]
            yield pa.RecordBatch.from_arrays([c for _, c in old] + made, [n for n, _ in old] + new.names)

    return df.mapInArrow(run, schema)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints; one is only set on a single machine whose session names none (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    have = spark.sparkContext._jsc.sc().getCheckpointDir()
    if have.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
    return have.get()


def delete(spark: SparkSession, path: str, at_exit: bool = False) -> None:
    """Delete a folder, now or when the session's process ends."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    store.deleteOnExit(target) if at_exit else store.delete(target, True)


class SharedTables:
    """Intermediate results as Parquet in the cluster's shared folder: they cut lineage and outlive executors, not the session."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{ensure_checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}"
        self.made = 0

    def store(self, df: DataFrame, large: bool = False) -> DataFrame:
        """``df``, written and read again; ``large`` says that its plan shuffled much, which is then let go."""
        path = f"{self.folder}/{self.made}"
        self.made += 1
        fresh = self.made == 1
        # hashes of words repeat: a dictionary of up to 8 MB a column halves them
        df.write.option("parquet.dictionary.page.size", str(8 << 20)).parquet(path)
        if fresh:
            delete(self.spark, self.folder, at_exit=True)
        if large:
            del df
            self.release()
        out = self.spark.read.parquet(path)
        out._stored_at = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a stored result that nothing reads any more."""
        delete(self.spark, df._stored_at)

    def release(self) -> None:
        """Let Spark delete shuffle files of plans that are done: it does so once the driver's garbage is collected.

        Listeners hold the last plan for a moment, so the second round is the one that finds it free.
        """
        for _ in range(2):
            time.sleep(0.3)
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """For each wanted name one like it that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


__all__ = ["SharedTables", "Words", "append_columns", "delete", "ensure_checkpoint_dir", "mix", "ngram_hash", "range_hash", "slices", "spans", "string_bytes", "table", "unused"]
