"""Texts in packs of bounded size, whatever the length of single texts.

A pack is about ``PACK_BYTES`` of text as one array of bytes. Texts beyond ``CUT_BYTES``
are cut behind a word into pieces that each carry the next few words as well, so that
every run of words that begins in a piece lies whole inside it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard

from .textops import slices, string_bytes

PACK_BYTES = 8 << 20
CUT_BYTES = 2 << 20

#: Cell counts of a pack are told apart from those of the next by number: partition of the scan, then place in it.
_PACKS_A_PARTITION = 1 << 14


@dataclass
class Pack:
    """Pieces of texts: bytes and offsets; ``own`` is where the words that count in a piece end; ``before`` counts words of the text before it."""

    raw: np.ndarray
    offsets: np.ndarray
    own: np.ndarray
    before: np.ndarray
    rows: pa.Table


def pieces(body: bytes, gap: str, more: int, most: int = CUT_BYTES) -> Iterator[tuple[int, int, int, int]]:
    """(start, end of own words, end, words before) of the pieces of a text; ``gap`` holds the bytes between words, as in a class of a regular expression."""
    inside, ahead = re.compile(f"[^{gap}]+".encode()), re.compile(f"(?:[{gap}]*[^{gap}]+){{0,{more}}}".encode())
    edge = re.compile(f"[{gap}]".encode())
    start = before = 0
    while start < len(body):
        cut = edge.search(body, start + most)
        own = cut.start() if cut else len(body)
        yield start, own, ahead.match(body, own).end(), before
        if own < len(body):
            before += sum(1 for _ in inside.finditer(body, start, own))
        start = own


def packs(batches: Iterator[pa.RecordBatch], gap: str, more: int, most: int = PACK_BYTES, cut: int = CUT_BYTES) -> Iterator[Pack]:
    """Arrow batches, the text in their first column, as packs; a piece carries up to ``more`` words of the next one."""
    held: list[Pack] = []
    size = 0
    for batch in batches:
        raw, offsets = string_bytes(batch.column(0))
        rest = pa.Table.from_batches([batch]).select(batch.schema.names[1:])
        for a, b in slices(offsets, cut):
            body = raw[offsets[a] : offsets[b]]
            if b - a == 1 and len(body) > cut:
                found = [(body[s:e], np.array([0, e - s]), np.array([o - s]), np.array([n])) for s, o, e, n in pieces(body.tobytes(), gap, more, cut)]
            else:
                found = [(body.copy(), offsets[a : b + 1] - offsets[a], np.diff(offsets[a : b + 1]), np.zeros(b - a, np.int64))]
            for part, edges, own, before in found:
                held.append(Pack(part, edges, own, before, rest.slice(a, b - a)))
                size += len(part)
                if size >= most:
                    yield _joined(held)
                    held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[Pack]) -> Pack:
    base = np.cumsum([0, *(len(p.raw) for p in held)])
    offsets = np.concatenate([p.offsets[:-1] + b for p, b in zip(held, base[:-1], strict=True)] + [base[-1:]])
    whole = lambda name: np.concatenate([getattr(p, name) for p in held])
    return Pack(whole("raw"), offsets, whole("own"), whole("before"), pa.concat_tables([p.rows for p in held]))


def numbered(found: Iterator[Pack], partition: int) -> Iterator[tuple[int, Pack]]:
    """Packs with a number that no other pack of the scan has."""
    for k, pack in enumerate(found):
        if k >= _PACKS_A_PARTITION:
            raise ValueError("a partition has too many packs: lower spark.sql.files.maxPartitionBytes")
        yield partition * _PACKS_A_PARTITION + k, pack


def squeeze(values: np.ndarray) -> bytes:
    """Fixed-size numbers compressed by byte planes: the high bytes of small numbers cost next to nothing."""
    width = values.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes())


def grow(packed: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).reshape(-1).view(kind)


__all__ = ["Pack", "grow", "numbered", "packs", "pieces", "squeeze"]
