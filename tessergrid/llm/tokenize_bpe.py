"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Long texts are cut before encoding, only at places that the pre-splitting pattern
can never join: between a non-space and a following white-space character.
Every alternative of such a pattern matches either a run of white space or
(one optional leading space and) a run without white space, so the tokens of the
parts, end to end, are those of the whole. A text without such a place is not cut.

The pattern's matcher cannot take a run of a million white-space characters. Such a run is
one match of the pattern, less its last character if a word follows: that match is encoded
by itself, as the one piece it is.

Defined cases: a null text encodes to no ids; an empty text likewise; decoding
returns raw bytes, so ids that end inside a character lose nothing.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from .textops import append_columns

#: Characters of text given to the encoder at a time.
PART_CHARS = 1 << 16
_SAFE = regex.compile(r"(?<=\S)(?=\s)")
#: Runs that are given to the merges as a piece, past the matcher.
LONG_RUN = 1 << 14
_SPACES = regex.compile(rf"\s{{{LONG_RUN},}}+")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, most: int = PART_CHARS) -> list[str]:
    """``text`` in parts of about ``most`` characters, cut at safe places only."""
    if len(text) <= most:
        return [text]
    out, a = [], 0
    while len(text) - a > most:
        m = _SAFE.search(text, a + most)
        if m is None:
            break
        out.append(text[a : m.start()])
        a = m.start()
    return [*out, text[a:]]


def encode(enc: tiktoken.Encoding, text: str | None) -> list[int]:
    if not text:
        return []
    if len(text) <= LONG_RUN:
        return enc.encode_ordinary(text)
    out: list[int] = []
    at = 0
    for run in _SPACES.finditer(text):
        # before a word the last character goes with the word, or is a match of its own
        end = run.end() if run.end() == len(text) else run.end() - 1
        out += [i for part in parts(text[at : run.start()]) for i in enc.encode_ordinary(part)]
        out += enc._encode_single_piece(text[run.start() : end].encode())
        at = end
    return out + [i for part in parts(text[at:]) for i in enc.encode_ordinary(part)]


def encode_texts(docs: DataFrame, rank_file: str, pattern: str, *, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` plus the array of token ids of each text."""

    def run(column: pa.Array) -> list[pa.Array]:
        enc = encoding(rank_file, pattern)
        return [pa.array([encode(enc, t) for t in column.to_pylist()], pa.list_(pa.int32()))]

    return append_columns(docs, text, run, f"{out} array<int>")


def decode_ids(df: DataFrame, rank_file: str, pattern: str, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` plus the raw bytes that each array of ids stands for."""

    def run(column: pa.Array) -> list[pa.Array]:
        enc = encoding(rank_file, pattern)
        return [pa.array([enc.decode_bytes(x or []) for x in column.to_pylist()], pa.binary())]

    return append_columns(df, ids, run, f"{out} binary")


def token_digests(docs: DataFrame, rank_file: str, pattern: str, *, text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode each text and decode what was encoded: ``docs`` with n_tokens, ids_sha256, decoded_sha256 (and ids) for the text.

    Both steps run on a text while it is at hand, so ids only cross to the JVM where they are asked for.
    """

    def run(column: pa.Array) -> list[pa.Array]:
        enc = encoding(rank_file, pattern)
        spelled = _decimal(rank_file, pattern)
        n, ids_sha, text_sha, kept = [], [], [], []
        for t in column:
            ids = encode(enc, t.as_py())
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(" ".join([spelled[i] for i in ids]).encode()).hexdigest())
            text_sha.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            if with_ids:
                kept.append(pa.array(ids, pa.int32()))
        made = [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
        return made + ([pa.ListArray.from_arrays(pa.array([0, *accumulate(n)], pa.int32()), pa.concat_arrays(kept))] if with_ids else [])

    return append_columns(docs, text, run, "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids).drop(text)


@lru_cache(maxsize=4)
def _decimal(rank_file: str, pattern: str) -> list[str]:
    return [str(i) for i in range(encoding(rank_file, pattern).max_token_value + 1)]


__all__ = ["decode_ids", "encode", "encode_texts", "encoding", "parts", "token_digests"]
