"""Substring dedup on words: of a run of ``length`` words that occurs again, only the first occurrence stays.

Most windows of a corpus occur once. A count-min sketch says so without moving them:

1. Texts are packed (``packs``), and each pack sketches its own windows: for two rows of
   counters, the cells of its windows in order. The rows are as wide as the input has
   bytes, so a sketch is not one array but blocks of cells; the packs' parts of a block
   meet in one task, which adds them up and answers each pack with one bit a window:
   whether the cell counts two or more. A window with a partner always gets both bits,
   one without hardly ever does.
2. Each pack keeps the windows with both bits. Those that repeat inside the pack lose
   their later occurrences there and then, so a passage that many documents share leaves
   a pack once. What is left meets by hash, packed by pack, and is grouped exactly, by two
   independent 64-bit hashes: all but the first of a group, by document and place, are lost.
3. The lost places meet their documents again in one join.

Nothing is collected or broadcast; a pack moves about three bytes a window for the sketch, and
18 more for windows that seem to repeat.

Words are runs of bytes other than ASCII white space, unchanged. Defined cases: a null
text has no words; texts of fewer than ``length`` words lose none; occurrences are ordered
by document id, then place, and rows with one id take nothing from each other at one
place, so an exact repetition of a row is treated as that row; rows with a null id take no
part and stay whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packs import grow, numbered, packs, squeeze
from .textops import BYTE_CODE, MULT, SharedTables, append_columns, mix, spans, unused

LENGTH = 20
GAP = r"\x20\x09-\x0D"
#: Cells of a block of the sketch, at most: what one task adds up at a time.
BLOCK_BITS = 23
#: Bytes of text to a shard of the exact grouping, about.
SHARD_BYTES = 8 << 20
#: Words longer than this are hashed by blake2b: polynomials are only safe for short ones.
SHORT = 64

_WORD = np.ones(256, bool)
_WORD[[32, *range(9, 14)]] = False
_OTHER_CODE = np.random.default_rng(20250101).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_OTHER_MULT = np.uint64(0xD1342543DE82EF95)
_GAP = re.compile(f"[{GAP}]".encode())


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, code: np.ndarray, base: np.uint64) -> np.ndarray:
    """A 64-bit hash of each word; a few hundred thousand words are spread out at a time."""
    size = end - start
    power = np.ones(SHORT, np.uint64)
    np.multiply.accumulate(np.full(SHORT - 1, base), out=power[1:])
    out = np.zeros(len(start), np.uint64)
    short = np.flatnonzero(size <= SHORT)
    for k in range(0, len(short), 1 << 18):
        own = short[k : k + (1 << 18)]
        n = size[own]
        edge = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(edge, n)
        out[own] = np.add.reduceat(code[raw[place + np.repeat(start[own], n)]] * power[place], edge)
    for k in np.flatnonzero(size > SHORT):
        out[k] = int.from_bytes(hashlib.blake2b(raw[start[k] : end[k]].tobytes(), digest_size=8, key=int(base).to_bytes(8, "little")).digest(), "little")
    return mix(out + size.astype(np.uint64) * base)


def window_hashes(part: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """A hash of each run of ``length`` words, by its first word."""
    have, out, at, weight = 1, None, 0, base
    while True:
        if length & have:
            n = max(len(part) - at, 0)
            out = part[at : at + n] if out is None else out[:n] * weight + part[at : at + n]
            at += have
        if have * 2 > length:
            return mix(out)
        m = max(len(part) - have, 0)
        part = part[:m] * weight + part[have : have + m]
        weight = np.uint64(int(weight) ** 2 & (1 << 64) - 1)
        have *= 2


class Windows:
    """The windows of a pack: the word each begins with, the piece it is in, its hash."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, length: int):
        self.raw, self.length = raw, length
        self.start, self.end = spans(_WORD[raw], offsets)
        row = np.searchsorted(offsets, self.start, side="right") - 1
        m = max(len(row) - length + 1, 0)
        self.word = np.flatnonzero(row[:m] == row[length - 1 :]) if m else np.zeros(0, np.int64)
        self.row = row[self.word]
        self.place = self.word - np.searchsorted(self.start, offsets)[self.row]
        self.hash = self._hashes(BYTE_CODE, MULT)

    def _hashes(self, code: np.ndarray, base: np.uint64) -> np.ndarray:
        if not len(self.word):
            return np.zeros(0, np.uint64)
        return window_hashes(word_hashes(self.raw, self.start, self.end, code, base), self.length, base)[self.word]

    def other_hash(self) -> np.ndarray:
        return self._hashes(_OTHER_CODE, _OTHER_MULT)

    def cells(self, bits: int) -> list[np.ndarray]:
        """The cells of the windows in the two rows of a sketch of 2^bits cells each."""
        down = np.uint64(64 - bits)
        return [(self.hash >> down).astype(np.int64), (mix(self.hash ^ _OTHER_MULT) >> down).astype(np.int64)]


def _packed(batches: Iterator[pa.RecordBatch], length: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(text, id, key) in, packs out."""
    for number, pack in numbered(packs(batches, GAP, length - 1), TaskContext.get().partitionId()):
        ids, keys = (pack.rows.column(c).to_numpy() for c in ("id", "key"))
        meta = [squeeze(x) for x in (pack.offsets.astype(np.int64), pack.before.astype(np.int64), ids.astype(np.int64), keys.astype(np.int32))]
        yield pa.RecordBatch.from_pylist([{"pack": number, "text": squeeze(pack.raw), "meta": meta}], schema)


def _sketch(batches: Iterator[pa.RecordBatch], length: int, bits: int, block: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Packs in; out: the cells of each by block of the sketch."""
    for batch in batches:
        for number, text, meta in zip(batch.column("pack").to_pylist(), batch.column("text"), batch.column("meta"), strict=True):
            found, rows = Windows(grow(text.as_py(), np.uint8), grow(meta[0].as_py(), np.int64), length), []
            for r, cells in enumerate(found.cells(bits)):
                cells = np.sort(cells)
                shard = cells >> block
                cut = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(cells))
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    inside = (cells[a:b] & ((1 << block) - 1)).astype(np.uint32)
                    rows.append({"pack": number, "shard": int(shard[a]) + (r << (bits - block)), "n": int(b - a), "cells": squeeze(np.diff(inside, prepend=np.uint32(0)))})
            yield pa.RecordBatch.from_pylist(rows, schema)


def _answers(parts: pa.Table, block: int) -> pa.Table:
    """The packs' parts of a block: added up, and one bit a window back to each, true where its cell counts two or more."""
    cells = [np.cumsum(grow(c, np.uint32), dtype=np.int64) for c in parts.column("cells").to_pylist()]
    count = np.zeros(1 << block, np.int32)
    for c in cells:
        edge = np.flatnonzero(np.diff(c, prepend=-1))
        count[c[edge]] += np.diff(np.append(edge, len(c))).astype(np.int32)
    several = count > 1
    return pa.table({"pack": parts.column("pack"), "shard": parts.column("shard"), "n": parts.column("n"), "bits": pa.array([np.packbits(several[c]).tobytes() for c in cells], pa.binary())})


_PARTS = pa.schema([("shard", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("keys", pa.binary()), ("places", pa.binary()), ("h1", pa.binary()), ("h2", pa.binary())])
_LOST = pa.schema([("id", pa.int64()), ("key", pa.int32()), ("place", pa.int32())])


def _candidates(packed: pa.Table, answers: pa.Table, length: int, bits: int, block: int, shards: int) -> pa.Table:
    """Of a pack the first occurrences of windows that may repeat, by shard of their hash; and, under a negative shard, later ones."""
    if not packed.num_rows or not answers.num_rows:
        return _PARTS.empty_table()
    raw = grow(packed.column("text")[0].as_py(), np.uint8)
    offsets, before, ids, keys = (grow(x.as_py(), t) for x, t in zip(packed.column("meta")[0], (np.int64, np.int64, np.int64, np.int32), strict=True))
    found = Windows(raw, offsets, length)
    answers = answers.sort_by("shard")
    told = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(answers.column("bits").to_pylist(), answers.column("n").to_pylist(), strict=True)])
    several = np.ones(len(found.word), bool)
    for r, cells in enumerate(found.cells(bits)):
        row = told[r * len(cells) : (r + 1) * len(cells)]
        several[np.argsort(cells)[row == 0]] = False
    keep = np.flatnonzero(several)
    row = found.row[keep]
    own, late = _firsts(found.hash[keep], found.other_hash()[keep], ids[row], before[row] + found.place[keep], keys[row])
    shard = (mix(own[0]) % np.uint64(shards)).astype(np.int32)
    made = []
    for number, (h1, h2, doc, place, key) in ((shard, own), (np.full(len(late[0]), -1 - packed.column("pack")[0].as_py() % shards, np.int32), late)):
        order = np.lexsort((place, key, doc, number))  # neighbouring windows of a document are written side by side
        cut = np.append(np.flatnonzero(np.diff(number[order], prepend=np.iinfo(np.int32).min)), len(order))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            at = order[a:b]
            hashes = (squeeze(h1[at]), squeeze(h2[at])) if number[at[0]] >= 0 else (None, None)
            made.append((int(number[at[0]]), b - a, squeeze(np.diff(doc[at], prepend=0)), squeeze(key[at]), squeeze(np.diff(place[at], prepend=0).astype(np.int32)), *hashes))
    return pa.Table.from_pylist([dict(zip(_PARTS.names, x, strict=True)) for x in made], _PARTS)


def _firsts(*columns: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(h1, h2, document, place, key) of windows, parted into the first of each hash (and rows of the same id and place) and later ones."""
    h1, h2, doc, place, key = columns
    order = np.lexsort((key, place, doc, h2, h1))
    h1, h2, doc, place, key = columns = [x[order] for x in columns]
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    first = (doc == doc[head]) & (place == place[head])
    again = np.zeros(len(h1), bool)  # a repetition of a whole row
    again[1:] = first[1:] & ~new[1:] & (key[1:] == key[:-1])
    return [x[first & ~again] for x in columns], [x[~first] for x in columns]


def _group(parts: pa.Table) -> pa.Table:
    """A shard's windows: all but the first of each hash are lost; out: the places in their documents."""
    column = lambda name, kind, sums: np.concatenate([np.cumsum(grow(x, kind), dtype=np.int64) if sums else grow(x, kind) for x in parts.column(name).to_pylist()])
    doc, key, place = column("ids", np.int64, True), column("keys", np.int32, False), column("places", np.int32, True)
    if parts.column("shard")[0].as_py() >= 0:
        doc, place, key = _firsts(column("h1", np.uint64, False), column("h2", np.uint64, False), doc, place, key)[1][2:]
    return pa.table([doc, key, place.astype(np.int32)], schema=_LOST)


def repeated_windows(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, key, places): for each document that loses words the first words of lost windows; ``key`` is the hash of its text."""
    spark = docs.sparkSession
    base = docs.select(F.col(text).alias("body"), F.col(doc_id).cast("bigint").alias("id"), F.hash(F.col(text)).alias("key")).where(f"id is not null and octet_length(body) >= {2 * length - 1}")
    total = base.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    bits = max(int(total - 1).bit_length(), 16)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block = max(min(BLOCK_BITS, bits - (partitions - 1).bit_length()), 10)
    shards = max(partitions, total // SHARD_BYTES)
    schema = pa.schema([("pack", pa.int64()), ("text", pa.binary()), ("meta", pa.list_(pa.binary()))])
    cells = pa.schema([("pack", pa.int64()), ("shard", pa.int32()), ("n", pa.int32()), ("cells", pa.binary())])
    kept = SharedTables(spark)
    made = kept.store(base.mapInArrow(lambda it: _packed(it, length, schema), "pack bigint, text binary, meta array<binary>"))
    parts = made.mapInArrow(lambda it: _sketch(it, length, bits, block, cells), "pack bigint, shard int, n int, cells binary")
    told = kept.store(parts.groupBy("shard").applyInArrow(lambda t: _answers(t, block), "pack bigint, shard int, n int, bits binary"), large=True)
    some = made.groupBy("pack").cogroup(told.groupBy("pack")).applyInArrow(lambda a, b: _candidates(a, b, length, bits, block, shards), "shard int, n int, ids binary, keys binary, places binary, h1 binary, h2 binary")
    return some.groupBy("shard").applyInArrow(_group, "id bigint, key int, place int").groupBy("id", "key").agg(F.collect_list("place").alias("places"))


def lost_words(places: pa.ListScalar, length: int) -> np.ndarray:
    """For each word of a text, as far as any is lost, whether it is."""
    if not places.is_valid or not len(places):
        return np.zeros(0, bool)
    at = places.values.to_numpy().astype(np.int64)
    step = np.zeros(int(at.max()) + length + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + length, -1)
    return np.cumsum(step[:-1]) > 0


def _words(body: bytes, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, a stretch of it at a time."""
    start = 0
    while start < len(body):
        cut = _GAP.search(body, start + most) if len(body) - start > most else None
        end = cut.start() if cut else len(body)
        yield body[start:end].split()  # bytes part at ASCII white space
        start = end


def remove_windows(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with n_words, n_removed, kept_sha256 and the kept words of each text, joined by one space; columns of those names are replaced."""
    found = SharedTables(docs.sparkSession).store(repeated_windows(docs, doc_id=doc_id, text=text, length=length), large=True)
    names = unused(docs, "lost_id", "lost_key", "lost_places", "lost_row")
    lost_id, lost_key, places, row = names
    found = found.toDF(*names[:3])
    both = docs.join(found, (docs[doc_id] == found[lost_id]) & (F.hash(docs[text]) == found[lost_key]), "left")
    both = both.withColumn(row, F.struct(F.col(text).alias("t"), F.col(places).alias("p"))).drop(*names[:3])

    def run(column: pa.Array) -> list[pa.Array]:
        n_words, n_removed, digest, kept = [], [], [], []
        for t, p in zip(column.field("t").cast(pa.large_binary()), column.field("p"), strict=True):
            lost = lost_words(p, length)
            n, left = 0, []
            for own in _words(t.as_py() or b""):
                gone = lost[n : n + len(own)]
                stay = own if not gone.any() else [w for w, g in zip(own, gone, strict=False) if not g] + own[len(gone) :]
                n += len(own)
                left += [b" ".join(stay)] if stay else []
            left = b" ".join(left)
            n_words.append(n)
            n_removed.append(int(lost.sum()))
            digest.append(hashlib.sha256(left).hexdigest())
            kept.append(left)
        return [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())]

    return append_columns(both, row, run, "n_words bigint, n_removed bigint, kept_sha256 string, kept string").drop(row)


def window_report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return remove_windows(docs.select(doc_id, text), doc_id=doc_id, text=text, length=length).select(doc_id, "n_words", "n_removed", "kept_sha256")


# windows are compared as their words joined by one space, which no word holds
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), part AS (SELECT doc_id, c, list_slice(w, c + 1, c + 519) AS w FROM (SELECT doc_id, w, unnest(range(0, len(w) - 19, 500)) AS c FROM d)
), win AS (SELECT doc_id, c + p AS p, array_to_string(list_slice(w, p, p + 19), ' ') AS s FROM (SELECT doc_id, c, w, unnest(range(1, len(w) - 18)) AS p FROM part)
), lost AS (SELECT doc_id, p FROM win QUALIFY rank() OVER (PARTITION BY s ORDER BY doc_id, p) > 1
), gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS k FROM lost
), word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM d
), kept AS (SELECT word.doc_id, count(gone.k) AS n, string_agg(x, ' ' ORDER BY word.k) FILTER (WHERE gone.k IS NULL) AS rest FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.k = word.k GROUP BY word.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

__all__ = ["Windows", "remove_windows", "repeated_windows", "window_report"]
