"""Suffix-array dedup of byte strings that repeat across documents.

Of two documents that share a string of ``length`` bytes, the one with the larger
id loses it. Equal strings are brought together without moving every suffix:

1. Each string of ``length`` bytes has a minimizer, the least hash among its
   grams of ``GRAM`` bytes, which depends on its bytes only. Neighbouring strings
   mostly have one minimizer, so a document is cut into segments (runs of string
   starts with one minimizer) that overlap by ``length`` - 1 bytes. Within a map
   batch equal segments are aggregated: a document that shares one with a smaller id
   of the batch loses it there and then, so a passage that many documents share
   leaves a batch once. Segments go, packed and compressed by batch, to the shard of
   their minimizer.
2. In a shard, minimizers of one document only are dropped, equal segments
   collapse, and so fall strings whose hash one document has alone. The suffixes of
   what is left are sorted by external induced sorting, which also yields
   common-prefix lengths; string starts whose neighbours share at least ``length``
   bytes are equal, and the least document id of such a run decides for all of it.
3. The removed spans meet their documents again in one join by id.

Defined cases: a null or empty text has no bytes and loses none; texts of fewer
bytes than ``length`` lose none; rows with one id are the same document and take
nothing from each other; rows with a null id take no part and stay whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .suffix_sort import MEMORY, DiskQueue, suffix_buckets
from .textops import BYTE_CODE, MULT, SharedTables, append_columns, give_back, mix, slices, spans, string_bytes, unused

LENGTH = 50
GRAM = 12
#: Bytes of segments a shard holds, about, and bytes of text a map batch packs at a time.
SHARD_BYTES = 8 << 20
PACK_BYTES = 8 << 20
_SEPARATOR = 255  # no byte of UTF-8


def minimizers(raw: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For each string of ``length`` bytes (by its start) the least 32-bit hash of its grams."""
    n = len(raw)
    if n < length:
        return np.zeros(0, np.uint32)
    word = raw.astype(np.uint64)
    have, code, at = 1, None, 0
    need = gram
    while True:
        if need & have:
            part = word[at : at + n - gram + 1]
            code = part * MULT if code is None else (code ^ (code >> np.uint64(29))) * MULT + part
            at += have
        if have * 2 > need:
            break
        step = min(have, 4)
        if have >= 8:
            raise ValueError("grams have at most 15 bytes")
        word = word[: len(word) - step] | (word[step:] << np.uint64(8 * step))
        have *= 2
    least = (mix(code) >> np.uint64(32)).astype(np.uint32)
    width, reach = length - gram + 1, 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if width > reach:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    return least


def _segments(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Starts, numbers of string starts, minimizers and rows of the segments of a slice."""
    least = minimizers(raw, length, gram)
    m = len(least)
    if not m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
    inside = np.zeros(m + 1, np.int32)
    size = np.diff(offsets)
    long_ = size >= length
    np.add.at(inside, offsets[:-1][long_], 1)
    np.add.at(inside, offsets[1:][long_] - length + 1, -1)
    valid = np.cumsum(inside[:-1]) > 0
    cuts = np.flatnonzero(least[1:] != least[:-1]) + 1
    starts, ends = spans(valid, np.unique(np.concatenate([cuts, offsets[offsets < m]])))
    return starts, ends - starts, least[starts], np.searchsorted(offsets, starts, side="right") - 1


def _gather(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    edge = np.cumsum(size) - size
    return raw[np.arange(int(size.sum())) + np.repeat(start - edge, size)]


def _content_keys(raw: np.ndarray, start: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
    """A hash of the content of each segment: of its strings, in order, and of how many they are."""
    if not len(start):
        return np.zeros(0, np.uint64)
    hashes = window_hashes(raw, length)
    step, edge = _ramp(size)
    return mix(np.add.reduceat(mix(hashes[np.repeat(start, size) + step] + step.astype(np.uint64)), edge) + size.astype(np.uint64))


_PACKED = ["shard", "n", "ids", "meta", "text"]


def _pack(batches: Iterator[pa.RecordBatch], shards: int, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(id, text) in; per shard and pack a row of compressed segments out, and a row of negative shard with what is lost already."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    held: list[tuple] = []
    bytes_held = 0

    def flush() -> pa.RecordBatch:
        nonlocal bytes_held
        start, size, least, ids, place, raw, key = [], [], [], [], [], [], []
        base = 0
        for own_raw, own_offsets, own_ids in held:
            s, n, m, row = _segments(own_raw, own_offsets, length, gram)
            key.append(_content_keys(own_raw, s, n, length))
            start.append(s + base)
            size.append(n)
            least.append(m)
            ids.append(own_ids[row])
            place.append(s - own_offsets[row])
            raw.append(own_raw)
            base += len(own_raw)
        held.clear()
        bytes_held = 0
        start, size, least, ids, place, raw, key = (np.concatenate(x) for x in (start, size, least, ids, place, raw, key))
        number, first = _collapse(raw, start, size + length - 1, key)
        lowest = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(lowest, number, ids)
        later = ids > lowest[number]
        gone = ids[later], np.stack([place[later], place[later] + size[later] + length - 1]).astype(np.int32)
        del key, number
        start, size, least, ids, place = (x[~later] for x in (start, size, least, ids, place))
        shard = (mix(least.astype(np.uint64)) % np.uint64(shards)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        cut = np.append(np.flatnonzero(np.diff(shard[order], prepend=-1)), len(order))
        rows: dict[str, list] = {c: [] for c in _PACKED}
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            own = order[a:b]
            meta = np.stack([least[own].view(np.int32), place[own].astype(np.int32), size[own].astype(np.int32)])
            text = _gather(raw, start[own], size[own] + length - 1)
            for c, v in zip(_PACKED, (int(shard[own[0]]), len(own), squeeze(ids[own].tobytes()), squeeze(meta.tobytes()), squeeze(text.tobytes())), strict=True):
                rows[c].append(v)
        if len(gone[0]):
            for c, v in zip(_PACKED, (-1 - int(gone[0][0]) % shards, len(gone[0]), squeeze(gone[0].tobytes()), squeeze(gone[1].tobytes()), b""), strict=True):
                rows[c].append(v)
        return pa.RecordBatch.from_arrays([pa.array(rows["shard"], pa.int32()), pa.array(rows["n"], pa.int32()), *(pa.array(rows[c], pa.binary()) for c in _PACKED[2:])], _PACKED)

    for batch in batches:
        raw, offsets = string_bytes(batch.column(1))
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b in slices(offsets, 1 << 18):
            held.append((raw[offsets[a] : offsets[b]].copy(), offsets[a : b + 1] - offsets[a], ids[a:b]))
            bytes_held += int(offsets[b] - offsets[a])
            if bytes_held > PACK_BYTES:
                yield flush()
                give_back()
    if held:
        yield flush()
        give_back()


def window_hashes(text: np.ndarray, length: int) -> np.ndarray:
    """A hash of each string of ``length`` bytes, by its start."""
    part, have, out, at = BYTE_CODE[text], 1, None, 0
    weight = MULT  # to the power of ``have``
    while True:
        if length & have:
            n = len(text) - at - have + 1
            out = part[at : at + n].copy() if out is None else out[:n] * weight + part[at : at + n]
            at += have
        if have * 2 > length:
            return out
        m = len(part) - have
        part = part[:m] * weight + part[have : have + m]
        weight = np.uint64(int(weight) ** 2 & (1 << 64) - 1)
        have *= 2


def _collapse(text: np.ndarray, start: np.ndarray, size: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each segment the number of its content, and for each content a segment that has it; ``key`` is a hash of the content."""
    _, first, number = np.unique(key, return_index=True, return_inverse=True)
    # equal hashes of unequal bytes would part here
    twin = first[number]
    alike = size == size[twin]
    both = np.flatnonzero(alike & (twin != np.arange(len(start))))
    for a, b in slices(np.concatenate([[0], np.cumsum(size[both])]), 1 << 20):
        some = both[a:b]
        edge = np.cumsum(size[some]) - size[some]
        differ = _gather(text, start[some], size[some]) != _gather(text, start[twin[some]], size[some])
        alike[some] = ~np.logical_or.reduceat(differ, edge)
    for k in np.flatnonzero(~alike):
        number[k], first = len(first), np.append(first, k)
    return number, first


def _ramp(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """0, 1, .. for each count, end to end, and where each begins."""
    edge = np.cumsum(count) - count
    return np.arange(int(count.sum())) - np.repeat(edge, count), edge


def repeated_spans(ids: np.ndarray, place: np.ndarray, count: np.ndarray, least: np.ndarray, text: np.ndarray, length: int, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard's segments: id, first byte and last byte + 1 of what later documents lose."""
    none = (np.zeros(0, np.int64),) * 3
    order = np.argsort(least)
    edge = np.flatnonzero(np.diff(least[order].astype(np.int64), prepend=-1))
    if not len(edge):
        return none
    several = np.minimum.reduceat(ids[order], edge) != np.maximum.reduceat(ids[order], edge)
    own = np.sort(order[np.repeat(several, np.diff(np.append(edge, len(order))))])
    if not len(own):
        return none
    start = (np.cumsum(count + length - 1) - (count + length - 1))[own]
    ids, place, count, least = ids[own], place[own], count[own], least[own]
    text = _gather(text, start, count + length - 1)
    start = np.cumsum(count + length - 1) - (count + length - 1)
    hashes = window_hashes(text, length)
    # a segment's content is known by the hashes of its strings
    step, edge = _ramp(count)
    key = mix(np.add.reduceat(mix(hashes[np.repeat(start, count) + step] + step.astype(np.uint64)), edge) + count.astype(np.uint64))
    number, first = _collapse(text, start, count + length - 1, key)
    lowest, highest = np.full(len(first), np.iinfo(np.int64).max), np.full(len(first), np.iinfo(np.int64).min)
    np.minimum.at(lowest, number, ids)
    np.maximum.at(highest, number, ids)
    size = count[first]
    step, edge = _ramp(size)
    winner = np.repeat(lowest, size)  # for each string of each distinct segment
    # strings of a minimizer with one content have no partner; neither have those whose hash one document has alone
    _, kind, members = np.unique(least[first], return_inverse=True, return_counts=True)
    busy = np.flatnonzero(np.repeat(members[kind] > 1, size))
    if len(busy):
        at = np.repeat(start[first], size)[busy] + step[busy]
        h = hashes[at]
        order = np.argsort(h)
        run = np.flatnonzero(np.diff(h[order], prepend=h[order[0]] ^ np.uint64(1)))
        most = np.repeat(highest, size)[busy]
        shared = np.minimum.reduceat(winner[busy][order], run) != np.maximum.reduceat(most[order], run)
        keep = np.zeros(len(busy), bool)
        keep[order] = np.repeat(shared, np.diff(np.append(run, len(order))))
        _sort_strings(text, at[keep], busy[keep], winner, length, memory)
    # a later copy of a segment loses all of it
    copy = np.flatnonzero(ids > lowest[number])
    lost = [(ids[copy], place[copy], place[copy] + count[copy] + length - 1)]
    rest = np.flatnonzero(ids == lowest[number])
    if len(rest):
        spot, begin = _ramp(count[rest])
        beaten = winner[np.repeat(edge[number[rest]], count[rest]) + spot] < np.repeat(ids[rest], count[rest])
        a, b = spans(beaten, begin)
        which = np.searchsorted(begin, a, side="right") - 1
        lost.append((ids[rest][which], place[rest][which] + a - begin[which], place[rest][which] + b - begin[which] + length - 1))
    return tuple(np.concatenate(x) for x in zip(*lost, strict=True))


def _sort_strings(text: np.ndarray, at: np.ndarray, number: np.ndarray, winner: np.ndarray, length: int, memory: int) -> None:
    """Suffix-sort the strings that start at ``at`` and give equal ones the least ``winner`` (by ``number``) among them."""
    if not len(at):
        return
    # neighbouring strings share their bytes; each stretch is closed by a byte that is in no text
    begin = np.flatnonzero(np.diff(at, prepend=at[0] - 2) != 1)
    run = np.diff(np.append(begin, len(at)))
    size = run + length
    edge = np.cumsum(size) - size
    joined = np.full(int(size.sum()), _SEPARATOR, np.uint8)
    step, _ = _ramp(size - 1)
    joined[np.repeat(edge, size - 1) + step] = _gather(text, at[begin], size - 1)
    string = np.full(len(joined), -1, np.int32)
    step, _ = _ramp(run)
    string[np.repeat(edge, run) + step] = np.arange(len(at), dtype=np.int32)
    for suffix, lcp in suffix_buckets(joined, 256, length, memory):
        which = string[suffix]
        window = np.flatnonzero(which >= 0)
        if len(window) < 2:
            continue
        # what two strings share is the least of what lies between them
        shared = np.minimum.reduceat(lcp[: window[-1] + 1], np.concatenate([[0], window[:-1] + 1]))
        own = number[which[window]]
        same = np.flatnonzero(np.concatenate([[True], shared[1:] < length]))
        winner[own] = np.repeat(np.minimum.reduceat(winner[own], same), np.diff(np.append(same, len(own))))


def _shard(packed: pa.Table, length: int, memory: int, spills: Accumulator | None) -> pa.Table:
    grow = zstandard.ZstdDecompressor().decompress
    ids = np.concatenate([np.frombuffer(grow(x), np.int64) for x in packed.column("ids").to_pylist()])
    meta = np.concatenate([np.frombuffer(grow(x), np.int32).reshape(-1, n) for x, n in zip(packed.column("meta").to_pylist(), packed.column("n").to_pylist(), strict=True)], axis=1)
    if packed.column("shard")[0].as_py() < 0:  # lost within a batch
        doc, a, b = ids, meta[0].astype(np.int64), meta[1].astype(np.int64)
    else:
        text = np.frombuffer(b"".join([grow(x) for x in packed.column("text").to_pylist()]), np.uint8)
        before = DiskQueue.total_spills
        doc, a, b = repeated_spans(ids, meta[1].astype(np.int64), meta[2].astype(np.int64), meta[0].view(np.uint32), text, length, memory)
        if spills is not None:
            spills.add(DiskQueue.total_spills - before)
        del text
    del ids, meta
    give_back()
    order = np.lexsort((a, doc))
    doc, pairs = doc[order], np.stack([a[order], b[order]], 1).astype(np.int32)
    cut = np.append(np.flatnonzero(np.diff(doc, prepend=doc[:1] - 1)), len(doc)) if len(doc) else np.zeros(1, np.int64)
    blobs = [pairs[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
    return pa.table({"span_id": pa.array(doc[cut[:-1]], pa.int64()), "spans": pa.array(blobs, pa.binary())})


def _merge(found: list[bytes] | None) -> np.ndarray:
    """Maximal runs of the bytes that spans cover."""
    if not found:
        return np.zeros((0, 2), np.int64)
    pairs = np.concatenate([np.frombuffer(x, np.int32).reshape(-1, 2) for x in found]).astype(np.int64)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.concatenate([[True], pairs[1:, 0] > reach[:-1]])
    first = np.flatnonzero(new)
    return np.stack([pairs[first, 0], reach[np.append(first[1:], len(pairs)) - 1]], 1)


def repeated_bytes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, shard_bytes: int = SHARD_BYTES, memory: int = MEMORY, spills: Accumulator | None = None) -> DataFrame:
    """(span_id, spans): for each document that loses bytes, lists of packed (first, last + 1) pairs.

    A queue of a sort moves to disk beyond ``memory`` bytes; ``spills`` counts how often that happens.
    """
    base = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("body")).where(f"id is not null and octet_length(body) >= {length}")
    total = base.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    grown = 1 + (length - 1) * 2 / (length - GRAM + 2)
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(-(-total * grown // shard_bytes)))
    packed = base.mapInArrow(lambda it: _pack(it, shards, length, GRAM), "shard int, n int, ids binary, meta binary, text binary")
    return packed.groupBy("shard").applyInArrow(lambda t: _shard(t, length, memory, spills), "span_id bigint, spans binary").groupBy("span_id").agg(F.collect_list("spans").alias("spans"))


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of each text (which may end inside a character)."""
    found = SharedTables(docs.sparkSession).store(repeated_bytes(docs, doc_id=doc_id, text=text, **options), large=True)
    span_id, found_spans, row = unused(docs, "span_id", "found_spans", "span_row")
    found = found.withColumnsRenamed({"span_id": span_id, "spans": found_spans})
    joined = docs.join(found, docs[doc_id] == found[span_id], "left").withColumn(row, F.struct(F.col(text).alias("t"), F.col(found_spans).alias("s"))).drop(span_id, found_spans)

    def run(column: pa.Array) -> list[pa.Array]:
        n_bytes, n_removed, n_spans, digest, kept = [], [], [], [], []
        for t, s in zip(column.field("t").cast(pa.large_binary()).to_pylist(), column.field("s").to_pylist(), strict=True):
            t = t or b""
            cuts = _merge(s)
            edges = [0, *cuts.ravel().tolist(), len(t)]
            left = b"".join([t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])
            n_bytes.append(len(t))
            n_removed.append(len(t) - len(left))
            n_spans.append(len(cuts))
            digest.append(hashlib.sha256(left).hexdigest())
            kept.append(left)
        return [pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary())]

    return append_columns(joined, row, run, "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary").drop(row)


def repeat_report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_repeats(docs.select(doc_id, text), doc_id=doc_id, text=text, **options).select(doc_id, "n_bytes", "n_removed", "n_spans", "kept_sha256")


__all__ = ["minimizers", "remove_repeats", "repeat_report", "repeated_bytes", "repeated_spans"]
