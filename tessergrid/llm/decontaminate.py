"""Benchmark decontamination with suffix arrays over training shards.

A shard is a slice of the documents of one task (about 4 MB of text, whole
documents only). Its words become integer ids over the benchmark's vocabulary,
the suffixes that can hold a match are sorted by prefix doubling, and the window
at the head of every suffix of every benchmark item is binary-searched in that
order. That gives, as an interval of the suffix array, every place where it
occurs; windows that follow each other in an item and in a document are one match,
so every document has its own longest match of each benchmark suffix. Documents are never
shuffled: a document's matches all lie in its own shard.

The benchmark is read in blocks of a bounded number of bytes; with more than
one block the partial answers meet in one aggregation by row.

Defined cases: null or empty texts (documents or items) have no words, so they
neither hit nor are hit; an item of fewer words than the window is one window;
items with a null id take no part; repeated items count once by id; repeated
document rows are answered row by row; empty tables give no rows or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import Words, append_columns, slices, spans, string_bytes

WINDOW = 10
BLOCK_BYTES = 16 << 20
#: Places of suffixes that are joined to matches at a time, whole documents only.
PLACES = 1 << 20
FIELDS = (
    "n_words bigint, n_hit bigint, leak_items array<string>,"
    " leak_matches array<struct<item_id:string,item_word:int,doc_word:int,n_words:int>>, leak_spans array<struct<first:int,last:int>>"
)


@dataclass
class Benchmark:
    """Items as ids over their own vocabulary; id 0 is no word of the benchmark."""

    vocab: np.ndarray  # sorted word hashes
    spelled: list[bytes]  # the word of each id - 1
    ids: np.ndarray  # all items, end to end
    first: np.ndarray  # item k is ids[first[k]:first[k+1]]
    names: list[str]
    window: int


def load_benchmark(rows: list[tuple[str, str | None]], window: int) -> Benchmark:
    raw, offsets = string_bytes(pa.array([t for _, t in rows], pa.string()))
    w = Words(raw.copy(), offsets)
    vocab, where, ids = np.unique(w.hash, return_index=True, return_inverse=True)
    spelled = [w.low[w.start[i] : w.end[i]].tobytes() for i in where]
    return Benchmark(vocab, spelled, ids.astype(np.int64) + 1, w.first, [n for n, _ in rows], window)


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of ``ids``, right to ``depth`` items, by prefix doubling."""
    n = len(ids)
    _, rank = np.unique(ids, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    reach = 1
    order = np.argsort(rank, kind="stable")
    while reach < depth and n > 1:
        after = np.zeros(n, np.int64)
        after[: max(n - reach, 0)] = rank[reach:]
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        step = np.ones(n, np.int64)
        step[1:] = sorted_key[1:] != sorted_key[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        if rank[order[-1]] == n:
            break
        reach *= 2
    return order


def _compare(ids: np.ndarray, at: np.ndarray, queries: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that suffix at[k] and query k share at their start, and whether the suffix is the smaller."""
    grid = at[:, None] + np.arange(queries.shape[1])
    text = np.where(grid < len(ids), ids[np.minimum(grid, len(ids) - 1)], -1)
    inside = np.arange(queries.shape[1])[None, :] < length[:, None]
    differ = (text != queries) & inside
    shared = np.where(differ.any(1), differ.argmax(1), length)
    pick = np.minimum(shared, queries.shape[1] - 1)
    rows = np.arange(len(at))
    return shared, (shared < length) & (text[rows, pick] < queries[rows, pick])


def lower_bound(ids: np.ndarray, order: np.ndarray, queries: np.ndarray, length: np.ndarray, beyond: bool = False) -> np.ndarray:
    """Rank of the first suffix that is not below each query (``beyond``: the first that is above all it begins)."""
    lo, hi = np.zeros(len(queries), np.int64), np.full(len(queries), len(order), np.int64)
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        shared, less = _compare(ids, order[np.minimum(mid, len(order) - 1)], queries, length)
        right = open_ & (less | (beyond & (shared >= length)))
        lo = np.where(right, mid + 1, lo)
        hi = np.where(open_ & ~right, mid, hi)
    return lo


class _Matcher:
    """The suffixes of all benchmark items, ready to be searched in a shard."""

    def __init__(self, bench: Benchmark):
        self.bench = bench
        sizes = np.diff(bench.first)
        item = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(bench.ids)) - bench.first[item]
        left = sizes[item] - place
        need = np.minimum(sizes[item], bench.window)
        ok = left >= need  # a suffix shorter than a window holds none
        self.item, self.place, self.need = item[ok], place[ok], need[ok]
        width = int(self.need.max()) if len(self.need) else 0
        grid = (bench.first[self.item] + self.place)[:, None] + np.arange(width)
        heads = np.where(np.arange(width) < self.need[:, None], bench.ids[np.minimum(grid, len(bench.ids) - 1)], 0) if width else np.zeros((0, 0), np.int64)
        # one window is searched once, however many items hold it
        self.heads, self.head_of = np.unique(heads, axis=0, return_inverse=True) if width else (heads, np.zeros(0, np.int64))
        self.head_of = self.head_of.reshape(-1)
        self.head_length = (self.heads > 0).sum(1)
        # the suffixes of head k are by_head[head_first[k]:head_first[k+1]]
        self.by_head = np.argsort(self.head_of, kind="stable")
        self.head_first = np.searchsorted(self.head_of[self.by_head], np.arange(len(self.heads) + 1))
        self.least = int(self.need.min()) if len(self.need) else 0

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.bench.vocab, hashes), len(self.bench.vocab) - 1)
        return np.where(self.bench.vocab[at] == hashes, at + 1, 0)

    def shard(self, w: Words) -> np.ndarray:
        """Occurrences of windows (word of the shard, head)."""
        none = np.zeros((0, 2), np.int64)
        if not self.least or not len(w):
            return none
        ids = self.word_ids(w.hash)
        known = ids > 0
        edge = np.flatnonzero(np.diff(w.row)) + 1
        starts, ends = spans(known, edge)
        long_ = ends - starts >= self.least  # shorter runs can hold no window
        starts, ends = starts[long_], ends[long_]
        if not len(starts):
            return none
        size = ends - starts
        # the runs end to end, each closed by an id that is no word, so that no match crosses
        at = np.cumsum(size + 1) - size - 1
        total = int((size + 1).sum())
        text, source = np.zeros(total, np.int64), np.full(total, -1, np.int64)
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        text[inner + np.repeat(at, size)] = ids[inner + np.repeat(starts, size)]
        source[inner + np.repeat(at, size)] = inner + np.repeat(starts, size)
        order = suffix_array(text, self.heads.shape[1])
        order = order[text[order] > 0]
        low = lower_bound(text, order, self.heads, self.head_length)
        high = lower_bound(text, order, self.heads, self.head_length, beyond=True)
        count = high - low
        inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        head = np.repeat(np.arange(len(count)), count)
        return np.stack([source[order[inside + np.repeat(low, count)]], head], 1)

    def longest(self, hits: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, suffix, word of the shard, words): the longest match of every suffix in every row, the first of equal ones.

        A match of a suffix goes on as long as the next suffix of its item has a window at the next word.
        """
        order = np.argsort(row, kind="stable")
        at, head, row = hits[order, 0], hits[order, 1], row[order]
        count = self.head_first[head + 1] - self.head_first[head]
        edge = np.append(np.flatnonzero(np.diff(row, prepend=-1)), len(row))
        for a, b in slices(np.concatenate([[0], np.cumsum(count)])[edge], PLACES):
            some = slice(edge[a], edge[b])
            n = count[some]
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            suffix = self.by_head[np.repeat(self.head_first[head[some]], n) + inside]
            word, own = np.repeat(at[some], n), np.repeat(row[some], n)
            place, item = self.place[suffix], self.item[suffix]
            by = np.lexsort((place, word - place, item, own))
            suffix, word, own, place, item = suffix[by], word[by], own[by], place[by], item[by]
            on = (np.diff(own) == 0) & (np.diff(item) == 0) & (np.diff(place) == 1) & (np.diff(word) == 1)
            ends = np.flatnonzero(~np.append(on, False))
            here = np.arange(len(suffix))
            size = self.need[suffix] + ends[np.searchsorted(ends, here)] - here
            by = np.lexsort((word, -size, suffix, own))
            suffix, word, own, size = suffix[by], word[by], own[by], size[by]
            first = (np.diff(own, prepend=-1) != 0) | (np.diff(suffix, prepend=-1) != 0)
            yield from zip(*(x[first].tolist() for x in (own, suffix, word, size)), strict=True)


def _answers(matcher: _Matcher, column: pa.Array) -> list[pa.Array]:
    raw, offsets = string_bytes(column)
    n_words, n_hit, items, matches, covered = [], [], [], [], []
    bench = matcher.bench
    by_head = None
    for a, b in slices(offsets):
        w = Words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        n_words.append(np.diff(w.first))
        hits = matcher.shard(w)
        hit_words = np.zeros(len(w) + 1, np.int64)
        per_row: dict[int, tuple[set, list]] = {}
        if len(hits):
            sure = _spelled_alike(bench, w, hits[:, 0], matcher.heads[hits[:, 1]], matcher.head_length[hits[:, 1]])
            hits = hits[sure]
            np.add.at(hit_words, hits[:, 0], 1)
            np.add.at(hit_words, hits[:, 0] + matcher.head_length[hits[:, 1]], -1)
            by_head = by_head or _items_by_head(matcher)
            for row, head in zip(w.row[hits[:, 0]].tolist(), hits[:, 1].tolist(), strict=True):
                per_row.setdefault(row, (set(), []))[0].update(by_head[head])
            for row, suffix, at, shared in matcher.longest(hits, w.row[hits[:, 0]]):
                per_row[row][1].append({"item_id": bench.names[matcher.item[suffix]], "item_word": int(matcher.place[suffix]), "doc_word": at - int(w.first[row]), "n_words": shared})
        hit = np.cumsum(hit_words)[:-1] > 0
        total = np.concatenate([[0], np.cumsum(hit)])
        n_hit.append(total[w.first[1:]] - total[w.first[:-1]])
        for row in range(b - a):
            names, found = per_row.get(row, ((), ()))
            items.append(sorted(names))
            matches.append(list(found))
            own = []
            if names:
                x = np.diff(np.concatenate([[0], hit[w.first[row] : w.first[row + 1]].astype(np.int8), [0]]))
                own = [{"first": int(p), "last": int(q) - 1} for p, q in zip(np.flatnonzero(x == 1), np.flatnonzero(x == -1), strict=True)]
            covered.append(own)
    cat = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
    return [cat(n_words), cat(n_hit), pa.array(items, pa.list_(pa.string())), pa.array(matches, _MATCHES), pa.array(covered, _SPANS)]


_MATCHES = pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("n_words", pa.int32())]))
_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def _items_by_head(matcher: _Matcher) -> list[set[str]]:
    out: list[set[str]] = [set() for _ in range(len(matcher.heads))]
    for head, item in zip(matcher.head_of.tolist(), matcher.item.tolist(), strict=True):
        out[head].add(matcher.bench.names[item])
    return out


def _spelled_alike(bench: Benchmark, w: Words, at: np.ndarray, heads: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the words themselves are equal, not just their hashes."""
    sure = np.ones(len(at), bool)
    for k in range(heads.shape[1]):
        for i in np.flatnonzero(sure & (length > k)).tolist():
            word = at[i] + k
            sure[i] = w.low[w.start[word] : w.end[word]].tobytes() == bench.spelled[heads[i, k] - 1]
    return sure


def find_leaks(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` plus n_words, n_hit, leak_items (sorted as strings), leak_matches (longest match of each
    benchmark suffix in this document) and leak_spans (hit words)."""
    bench = items.select(F.col(item_id).cast("string").alias("i"), F.coalesce(item_text, F.lit("")).alias("t")).where("i is not null")
    size = bench.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)), F.count("*")).first()
    blocks = max(1, -(-(size[0] + 64 * size[1]) // block_bytes))
    spark = docs.sparkSession

    def one(base: DataFrame, k: int) -> DataFrame:
        rows = [tuple(r) for r in bench.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k).collect()]
        shared = spark.sparkContext.broadcast(_Matcher(load_benchmark(sorted(set(rows)), window)))
        return append_columns(base, text, lambda column: _answers(shared.value, column), FIELDS)

    if blocks == 1:
        return one(docs, 0)
    # more blocks: what one block finds is carried along in the row; no shuffle and no join
    mark = "_"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    out = one(docs, 0)
    for k in range(1, blocks):
        out = out.withColumnsRenamed({c: f"{mark}{c}" for c in ("n_hit", "leak_items", "leak_matches", "leak_spans")})
        out = one(out, k)
        both = F.concat(f"{mark}leak_spans", "leak_spans")
        words = F.array_distinct(F.flatten(F.transform(both, lambda s: F.sequence(s["first"], s["last"]))))
        out = (
            out.withColumn("n_hit", F.size(words).cast("bigint"))
            .withColumn("leak_items", F.array_sort(F.array_union(f"{mark}leak_items", "leak_items")))
            .withColumn("leak_matches", F.concat(f"{mark}leak_matches", "leak_matches"))
            .withColumn("leak_spans", both)
            .drop(*[f"{mark}{c}" for c in ("n_hit", "leak_items", "leak_matches", "leak_spans")])
        )
    return out


def remove_leaked(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents without a hit word, with the columns they came with."""
    text = options.get("text", "text")
    marked = docs.withColumn("_text", F.col(text))
    found = find_leaks(marked.withColumnsRenamed({c: f"__{c}" for c in docs.columns}), items, **options | {"text": "_text"})
    return found.where(F.size("leak_items") == 0).select(*[F.col(f"__{c}").alias(c) for c in docs.columns])


def leak_report(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the number of longest matches with the longest of them."""
    text = options.get("text", "text")
    found = find_leaks(docs.select(doc_id, text), items, **options)
    return found.select(
        doc_id,
        "n_words",
        "n_hit",
        F.size("leak_items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "leak_items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.coalesce(F.array_max(F.transform("leak_matches", lambda m: m["n_words"])), F.lit(0)).cast("bigint").alias("longest_match"),
    )


__all__ = ["find_leaks", "leak_report", "remove_leaked", "suffix_array", "lower_bound"]
