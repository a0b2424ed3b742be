"""Where phrases of a table stand in texts, word for word: a trie over word ids, walked from all words of a batch at once.

A phrase table of a checked size goes to every task as flat arrays; each text is read once, and a row leaves the task only
where a phrase ends. A larger table is joined to the runs of its phrases' lengths instead. Both give the same places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of all phrases up to which they are sent to the tasks; more are joined.
SENT = 32 << 20


class Trie:
    """Phrases as arrays: ``edges`` holds node x words + word in order, ``child`` the node each leads to, ``phrase`` what ends at a node."""

    def __init__(self, phrases: list[list[str]]):
        self.words = pa.array(sorted({w for p in phrases for w in p}), pa.string())
        lengths = np.array([len(p) for p in phrases], dtype=np.int64)
        flat = pc.index_in(pa.array([w for p in phrases for w in p], pa.string()), value_set=self.words).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        at = np.zeros(len(phrases), dtype=np.int64)
        ends, edges, children, made = np.full(len(phrases), -1, dtype=np.int64), [], [], 1
        for depth in range(int(lengths.max(initial=0))):
            going = np.flatnonzero(lengths > depth)
            keys, which = np.unique(at[going] * len(self.words) + flat[starts[going] + depth], return_inverse=True)
            edges.append(keys)
            children.append(made + np.arange(len(keys)))
            at[going] = made + which
            made += len(keys)
            done = going[lengths[going] == depth + 1]
            ends[done] = at[done]
        self.edges, self.child = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (edges, children))
        order = np.argsort(self.edges)
        self.edges, self.child = self.edges[order], self.child[order]
        self.phrase = np.full(made, -1, dtype=np.int64)
        self.phrase[ends[ends >= 0]] = np.flatnonzero(ends >= 0)

    def step(self, nodes: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The nodes that words lead to, -1 where there is none."""
        if not len(self.edges):
            return np.full(len(nodes), -1, dtype=np.int64)
        keys = nodes * len(self.words) + words
        i = np.minimum(np.searchsorted(self.edges, keys), len(self.edges) - 1)
        return np.where((words >= 0) & (self.edges[i] == keys), self.child[i], -1)

    def places(self, words: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, place in the row, phrase) of all occurrences, shorter phrases first; only starts that still match go on."""
        offsets = words.offsets.to_numpy().astype(np.int64)
        offsets, flat = offsets - offsets[0], words.flatten()
        ids = pc.fill_null(pc.index_in(flat, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(words)), np.diff(offsets))
        start = np.flatnonzero(ids >= 0)
        node, depth = np.zeros(len(start), dtype=np.int64), 0
        while len(start):
            inside = start + depth < offsets[row[start] + 1]
            start, node = start[inside], node[inside]
            node = self.step(node, ids[start + depth])
            start, node = start[node >= 0], node[node >= 0]
            depth += 1
            found = self.phrase[node]
            hit = found >= 0
            if hit.any():
                yield row[start[hit]], start[hit] - offsets[row[start[hit]]], found[hit]


def _walked(rows: DataFrame, phrases: list[str], key: str) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(phrases)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(sent.value, pa.string())
        trie = Trie([p.split(" ") for p in sent.value])
        for batch in batches:
            lists = batch.column(1)
            lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
            for row, place, phrase in trie.places(lists):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), names.take(pa.array(phrase)), pa.array(place, pa.int64())], [key, "phrase", "place"])

    return rows.mapInArrow(find, f"{rows.select(key).schema[0].simpleString().replace(':', ' ', 1)}, phrase string, place bigint")


def _joined(rows: DataFrame, phrases: DataFrame, key: str, lengths: list[int]) -> DataFrame:
    """Runs of the lengths that phrases have, by an equi join."""
    none = F.array().cast("array<struct<place:int,phrase:string>>")

    def runs(n: int) -> Column:
        some = F.transform(F.sequence(F.lit(0), F.size("said") - n), lambda i: F.struct(i.alias("place"), F.array_join(F.slice("said", i + 1, n), " ").alias("phrase")))
        return F.when(F.size("said") >= n, some).otherwise(none)

    cut = rows.select(key, F.explode(F.flatten(F.array(*[runs(n) for n in lengths]))).alias("r")).select(key, "r.phrase", F.col("r.place").cast("bigint").alias("place"))
    return cut.join(phrases, "phrase").select(key, "phrase", "place")


def phrase_places(texts: DataFrame, key: str, words: Column, phrases: DataFrame, sent: int = SENT) -> DataFrame:
    """(key, phrase, place): every place, counted in words from 0, at which a phrase starts in the text of a row; overlaps count.

    ``words`` is the row's array of words; ``phrases`` has a column ``phrase`` of words with one blank between. Null and empty
    phrases and texts have no places, repeated phrases count once. ``key`` may repeat: each row is a text of its own.
    """
    rows = texts.select(key, F.coalesce(words, F.array().cast("array<string>")).alias("said")).where(F.size("said") > 0)
    spelled = phrases.select("phrase").where("phrase <> ''").distinct()
    size = spelled.agg(F.sum(F.char_length("phrase")).alias("chars"), F.collect_set(F.size(F.split("phrase", " "))).alias("lengths")).first()
    if (size["chars"] or 0) > sent:
        return _joined(rows, spelled, key, sorted(size["lengths"]))
    return _walked(rows, [r["phrase"] for r in spelled.collect()], key)


def phrase_counts(texts: DataFrame, key: str, words: Column, phrases: DataFrame, sent: int = SENT) -> DataFrame:
    """(phrase, n_texts, n_places): keys that have a phrase, and all its places."""
    each = phrase_places(texts, key, words, phrases, sent).groupBy("phrase", key).agg(F.count("*").alias("n"))
    return each.groupBy("phrase").agg(F.count("*").alias("n_texts"), F.sum("n").alias("n_places"))
