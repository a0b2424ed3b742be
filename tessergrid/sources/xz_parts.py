"""The data source ``xz_parts``: rows as JSON lines in XZ parts, each named with its size, hash and ranges in a manifest.

Parts are written and read by tasks, one a partition; the driver sees the manifest only, an entry a part. A part is
unpacked as a stream and hashed as it is read; one that is missing, cut short or changed fails the query. Filters are
compared with the manifest's ranges, so that parts without a match are not opened; Spark still applies them to rows.
Paths are those that ``pyarrow.fs`` reaches. Dates, timestamps and decimals are written as Arrow spells them; binary
columns and maps, and dates and the like inside arrays and structs, are refused. An empty table is a manifest without parts.
"""

from __future__ import annotations

import hashlib
import json
import lzma
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date, datetime

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json as pajson
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "xz_parts"
_MANIFEST = "manifest.json"
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Bytes that are unpacked at a time.
CHUNK = 4 << 20
#: What JSON escapes in strings.
_ESCAPED = r'["\\\x00-\x1f]'
#: Strings beyond so many characters have no range.
_LONGEST_BOUND = 64


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _manifest(path: str) -> dict:
    store, folder = _store(path)
    with store.open_input_stream(f"{folder}/{_MANIFEST}") as f:
        return json.loads(f.read())


def _spelled(t: pa.DataType) -> bool:
    """Whether values are written as text."""
    return pa.types.is_temporal(t) or pa.types.is_decimal(t)


def _refused(t: pa.DataType, inside: bool = False) -> bool:
    if pa.types.is_binary(t) or pa.types.is_large_binary(t) or pa.types.is_map(t) or (inside and _spelled(t)):
        return True
    return any(_refused(t.field(i).type, True) for i in range(t.num_fields))


def _range(column: pa.ChunkedArray) -> list | None:
    """[least, greatest] as JSON can hold them, [] if there are only nulls, None if ranges are not kept for the type."""
    t = column.type
    if not (pa.types.is_integer(t) or pa.types.is_string(t) or pa.types.is_date(t) or pa.types.is_timestamp(t)):
        return None
    low, high = (pc.min_max(column)[k].as_py() for k in ("min", "max"))
    if low is None:
        return []
    if isinstance(low, str):
        return [low, high] if max(len(low), len(high)) <= _LONGEST_BOUND else None
    return [low, high] if isinstance(low, int) else [low.isoformat(), high.isoformat()]


def _text(x: str) -> pa.Scalar:
    return pa.scalar(x, pa.large_string())


def _json_values(column: pa.Array) -> pa.Array:
    """Each value as JSON spells it: whole columns at a time, but for nested ones and strings that need escapes."""
    t = column.type
    if _spelled(t) or pa.types.is_string(t):
        column = pc.cast(column, pa.large_string())
        if pc.any(pc.match_substring_regex(column, _ESCAPED)).as_py():
            made = pa.array([json.dumps(v, ensure_ascii=False) for v in column.to_pylist()], pa.large_string())
        else:
            made = pc.binary_join_element_wise(_text('"'), column, _text('"'), _text(""))
    elif pa.types.is_integer(t) or pa.types.is_boolean(t):
        made = pc.cast(column, pa.large_string())
    elif pa.types.is_floating(t):
        made = pa.array(json.dumps(column.to_pylist())[1:-1].split(", "), pa.large_string())
    else:
        made = pa.array([json.dumps(v, ensure_ascii=False) for v in column.to_pylist()], pa.large_string())
    return pc.fill_null(made, "null")


def _json_lines(batch: pa.RecordBatch) -> memoryview | bytes:
    """The rows of a batch as JSON, a line each."""
    if not batch.num_rows or not batch.num_columns:
        return b"{}\n" * batch.num_rows
    pieces = [x for k, f in enumerate(batch.schema) for x in (_text(("{" if k == 0 else ", ") + json.dumps(f.name, ensure_ascii=False) + ": "), _json_values(batch.column(k)))]
    lines = pc.binary_join_element_wise(*pieces, _text("}\n"), _text(""))
    _, edges, data = lines.buffers()
    return memoryview(data)[: memoryview(edges).cast("b").cast("q")[len(lines)]]


@dataclass
class _Written(WriterCommitMessage):
    parts: list[dict]


@dataclass
class _Writer(DataSourceArrowWriter):
    path: str
    schema: StructType
    overwrite: bool

    def __post_init__(self) -> None:
        store, folder = _store(self.path)
        if not self.overwrite and store.get_file_info(f"{folder}/{_MANIFEST}").type != fs.FileType.NotFound:
            raise ValueError(f"{self.path} holds parts already")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, folder = _store(self.path)
        store.create_dir(folder)
        # a task that is run again writes another file, and only those that Spark commits are in the manifest
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.json.xz"
        rows, ranges, sha = 0, {}, hashlib.sha256()
        size, packer = 0, lzma.LZMACompressor(preset=1)
        with store.open_output_stream(f"{folder}/{name}") as out:

            def put(packed: bytes) -> None:
                nonlocal size
                sha.update(packed)
                size += len(packed)
                out.write(packed)

            for batch in iterator:
                if refused := [f.name for f in batch.schema if _refused(f.type)]:
                    raise ValueError(f"columns of types that parts do not hold: {refused}")
                for f in batch.schema:
                    ranges[f.name] = _joined(ranges.get(f.name, []), _range(batch[f.name]))
                put(packer.compress(_json_lines(batch)))
                rows += batch.num_rows
            put(packer.flush())
        if not rows:
            store.delete_file(f"{folder}/{name}")
            return _Written([])
        return _Written([{"name": name, "bytes": size, "sha256": sha.hexdigest(), "rows": rows, "ranges": ranges}])

    def commit(self, messages: list[_Written | None]) -> None:
        store, folder = _store(self.path)
        parts = sorted((p for m in messages if m for p in m.parts), key=lambda p: p["name"])
        store.create_dir(folder)
        with store.open_output_stream(f"{folder}/{_MANIFEST}") as out:
            out.write(json.dumps({"format": FORMAT, "schema": self.schema.jsonValue(), "parts": parts}, ensure_ascii=False).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        store, folder = _store(self.path)
        for m in messages:
            for p in m.parts if m else []:
                store.delete_file(f"{folder}/{p['name']}")


def _joined(a: list | None, b: list | None) -> list | None:
    if a is None or b is None:
        return None
    return [min(a[0], b[0]), max(a[1], b[1])] if a and b else a or b


@dataclass
class _Part(InputPartition):
    part: dict


@dataclass
class _Hashed:
    """A file that hashes what is read of it."""

    raw: pa.NativeFile
    size: int = 0
    sha: hashlib._Hash = field(default_factory=hashlib.sha256)

    def read(self, n: int = -1) -> bytes:
        got = self.raw.read(n)
        self.size += len(got)
        self.sha.update(got)
        return got

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return False

    @property
    def closed(self) -> bool:
        return self.raw.closed


@dataclass
class _Reader(DataSourceReader):
    path: str
    schema: StructType
    parts: list[dict]

    def partitions(self) -> list[_Part]:
        return [_Part(p) for p in self.parts]

    def read(self, partition: _Part | None) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if partition is None:  # Spark asks so where there are no partitions
            return
        part, arrow = partition.part, to_arrow_schema(self.schema)
        store, folder = _store(self.path)
        try:
            with store.open_input_stream(f"{folder}/{part['name']}") as raw:
                source = _Hashed(raw)
                rows = 0
                for lines in _lines(lzma.LZMAFile(source)):
                    batch = _parsed(lines, arrow)
                    rows += batch.num_rows
                    yield batch
                while source.read(CHUNK):  # what stands behind the packed rows counts too
                    pass
        except (lzma.LZMAError, EOFError, FileNotFoundError, UnicodeDecodeError, json.JSONDecodeError, pa.ArrowInvalid) as e:
            raise ValueError(f"{part['name']} cannot be read: {e}") from e
        if (source.size, source.sha.hexdigest(), rows) != (part["bytes"], part["sha256"], part["rows"]):
            raise ValueError(f"{part['name']} is not the part that the manifest names")


class _PruningReader(_Reader):
    """Leaves out the parts that no row of a filter can be in."""

    def pushFilters(self, filters: list[Filter]) -> list[Filter]:
        for f in filters:
            self.parts = [p for p in self.parts if _may_hold(f, p["ranges"])]
        return filters


def _may_hold(f: Filter, ranges: dict[str, list | None]) -> bool:
    if not isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual | In) or len(f.attribute) != 1:
        return True
    bounds = ranges.get(f.attribute[0])
    if bounds is None:
        return True
    if not bounds:
        return False  # only nulls, which compare with nothing
    low, high = bounds
    values = list(f.value) if isinstance(f, In) else [f.value]
    if not all(type(v) is type(low) for v in values):
        low, high = _as(low, values[0]), _as(high, values[0])
    if low is None or not all(type(v) is type(low) for v in values):
        return True
    match f:
        case GreaterThan():
            return high > values[0]
        case GreaterThanOrEqual():
            return high >= values[0]
        case LessThan():
            return low < values[0]
        case LessThanOrEqual():
            return low <= values[0]
    return any(low <= v <= high for v in values)


def _as(bound: object, value: object) -> object:
    """A bound of dates or times as such a value; None where the two do not compare."""
    if not isinstance(bound, str) or not isinstance(value, date):
        return None
    made = type(value).fromisoformat(bound)
    aware = isinstance(made, datetime) and (made.tzinfo is None) != (value.tzinfo is None)
    return None if aware else made


def _lines(source: lzma.LZMAFile) -> Iterator[list[bytes]]:
    rest: list[bytes] = []
    while chunk := source.read(CHUNK):
        *lines, last = chunk.split(b"\n")
        if lines:
            lines[0] = b"".join([*rest, lines[0]])
            rest = []
            yield lines
        rest.append(last)
    if any(rest):
        raise EOFError("the last line has no end")


def _parsed(lines: list[bytes], arrow: pa.Schema) -> pa.RecordBatch:
    """Lines as rows, by Arrow's own parser where it reads them; Python's knows NaN and infinities too, and says what is wrong."""
    data = b"\n".join(lines) + b"\n"
    spelled = pa.schema([pa.field(f.name, pa.string() if _spelled(f.type) else f.type) for f in arrow])
    options = pajson.ReadOptions(use_threads=False, block_size=max(len(data), 1) + 1), pajson.ParseOptions(explicit_schema=spelled, unexpected_field_behavior="ignore")
    try:
        table = pajson.read_json(pa.BufferReader(data), *options).combine_chunks()
        if table.num_rows != len(lines):
            raise pa.ArrowInvalid("lines are not rows")
        columns = [table.column(f.name).chunk(0).cast(f.type) for f in arrow]
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, pa.ArrowKeyError, IndexError, KeyError):
        return _batch([json.loads(x) for x in lines], arrow)
    return pa.RecordBatch.from_arrays(columns, schema=arrow)


def _batch(rows: list[dict], arrow: pa.Schema) -> pa.RecordBatch:
    columns = []
    for f in arrow:
        values = [r.get(f.name) for r in rows]
        columns.append(pc.cast(pa.array(values, pa.string()), f.type) if _spelled(f.type) else pa.array(values, f.type))
    return pa.RecordBatch.from_arrays(columns, schema=arrow)


class XzParts(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return StructType.fromJson(_manifest(self.options["path"])["schema"])

    def reader(self, schema: StructType) -> _Reader:
        manifest = _manifest(self.options["path"])
        if manifest.get("format") != FORMAT:
            raise ValueError(f"not a manifest of {FORMAT}")
        kind = _PruningReader if self.options.get("prune") == "true" else _Reader
        return kind(self.options["path"], schema, manifest["parts"])

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], schema, overwrite)


def write_parts(rows: DataFrame, path: str, by: str | None = None, parts: int | None = None) -> None:
    """A part a partition; ``by`` deals rows to parts by ranges of a column, which filters on it profit from."""
    rows.sparkSession.dataSource.register(XzParts)
    if by is not None:
        rows = rows.repartitionByRange(*([parts] if parts else []), by)
    rows.write.format(FORMAT).mode("append").save(path)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all parts. Filters reach the manifest where the session pushes filters to Python sources."""
    spark.dataSource.register(XzParts)
    prune = str(spark.conf.get(_PUSHDOWN, "false")).lower()
    return spark.read.format(FORMAT).option("prune", prune).load(path)
