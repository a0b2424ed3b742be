"""Cutting texts into units with exact offsets."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIT_BYTES = 4000
CONTEXT = 256
#: Characters of units and context that a task holds before it hands them on.
BATCH_CHARS = 1 << 20
#: A unit may end after a line break, or after the white space behind a sentence.
_BOUNDARY = re.compile(r"\n|(?<=[.!?])\s+")


def spans(text: str, most: int = UNIT_BYTES) -> list[tuple[int, int]]:
    """Character ranges of at most ``most`` UTF-8 bytes that together are the text; a unit that does not reach the
    end stops at the last boundary in its second half, where there is one."""
    raw = text.encode("utf-8", "surrogatepass")
    out, at, chars = [], 0, 0
    while at < len(raw):
        end = min(at + most, len(raw))
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        part = raw[at:end].decode("utf-8", "surrogatepass")
        if end < len(raw):
            ends = [m.end() for m in _BOUNDARY.finditer(part)]
            if ends and ends[-1] >= len(part) // 2:
                part = part[: ends[-1]]
        out.append((chars, chars + len(part)))
        chars += len(part)
        at += len(part.encode("utf-8", "surrogatepass"))
    return out


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@F.pandas_udf(_SPAN)
def unit_spans(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"start": a, "end": b} for a, b in spans(t or "")])


def retrieval_units(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, unit, start, end, unit_text, before, after): units with the characters around them; a text is cut once.

    Units leave a task in batches of about ``BATCH_CHARS`` characters, whatever the number and length of the texts that come in.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("unit", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in ("unit_text", "before", "after")]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [batch.schema.field(0).type, *[pa.int32()] * 3, *[pa.string()] * 3]
            rest, held = [[] for _ in kinds[1:]], 0
            of: list[int] = []

            def made() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *[pa.array(c, k) for c, k in zip(rest, kinds[1:], strict=True)]], names=schema.names)

            for i, cell in enumerate(batch.column(1)):
                t = cell.as_py() or ""
                for unit, (a, b) in enumerate(spans(t)):
                    of.append(i)
                    for column, value in zip(rest, (unit, a, b, t[a:b], t[max(0, a - CONTEXT) : a], t[b : b + CONTEXT]), strict=True):
                        column.append(value)
                    held += b - a + 2 * CONTEXT
                    if held > BATCH_CHARS:
                        yield made()
                        of, rest, held = [], [[] for _ in kinds[1:]], 0
            if of:
                yield made()

    return rows.mapInArrow(cut, schema)


def regions(docs: DataFrame, doc_id: str, text: str, size: int = 6000, context: int = 600) -> DataFrame:
    """(doc_id, region, start, region_text, before, after): fixed cuts of ``size`` characters, without Python.

    A text is cut once, from front to back; context comes from the neighbours, not from the text again.
    """
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"(?s)(.{{1,{size}}})"))
    beside = lambda x, i, step: F.when((i + step >= 0) & (i + step < F.size(x)), F.get(x, i + step)).otherwise("")
    cut = F.transform("pieces", lambda p, i: F.struct(p.alias("region_text"), F.right(beside(F.col("pieces"), i, -1), F.lit(context)).alias("before"), F.left(beside(F.col("pieces"), i, 1), F.lit(context)).alias("after")))
    each = docs.select(F.col(doc_id).alias("doc_id"), pieces.alias("pieces")).select("doc_id", F.posexplode(cut).alias("region", "r"))
    return each.select("doc_id", "region", (F.col("region") * size).alias("start"), "r.*")


def excerpt(text: Column, wanted: list[str], allowance: int, anchor: Column | None = None) -> Column:
    """Struct of start and end of the stretch of ``allowance`` characters to show.

    It begins a quarter of the allowance before its anchor: the given one, else the first of the words of the text that
    the most distinct wanted words follow within the allowance, else the start.
    """
    sought = frozenset(w.casefold() for w in wanted)

    def best(t: str) -> int:
        hits = [(m.start(), m.group().casefold()) for m in re.finditer(r"\w+", t) if m.group().casefold() in sought]
        top, where, last, counts = 0, 0, 0, Counter()
        for at, word in hits:  # the stretch from each hit on; its end only moves forward
            while last < len(hits) and hits[last][0] < at + allowance:
                counts[hits[last][1]] += 1
                last += 1
            distinct = sum(1 for n in counts.values() if n)
            if distinct > top:
                top, where = distinct, at
            counts[word] -= 1
        return where

    @F.pandas_udf(_SPAN.elementType)
    def cut(texts: pd.Series, anchors: pd.Series) -> pd.DataFrame:
        rows = []
        for t, a in zip(texts, anchors, strict=True):
            t = t or ""
            at = best(t) if a is None or a != a else int(a)
            start = max(0, min(at - allowance // 4, len(t) - allowance))
            rows.append((start, min(len(t), start + allowance)))
        return pd.DataFrame(rows, columns=["start", "end"])

    return cut(text, F.lit(None).cast("int") if anchor is None else anchor)
