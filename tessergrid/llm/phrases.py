"""Phrase collocations by hierarchical pair naming.

A phrase of k words is a pair of neighbouring phrases of k - 1 words that overlap in all
but one word, so a corpus is read as names, level by level:

1. Texts are packed (``packs``). Each pack names its distinct words by numbers of its own
   and keeps its texts as those numbers, with a gap where a piece of text ends.
2. The packs' names of a word meet by language and spelling: their counts are added up, and
   the least (pack, number) is the name that all use from then on. What is rarer than
   ``least`` has no name. The names go back to the packs that use them.
3. A pack replaces each two neighbouring names by its own number of the pair, counts those,
   and the pairs meet in turn, now by the two names, and so on up to ``most_words``. A
   phrase can only be frequent if both its halves are, so nothing is lost.

The two names of a pair point to its parents. Cutting a phrase needs the counts of all its
first and last parts: those are its parents' and the parents themselves. A phrase is part of
a longer one that is no rarer than some share of it exactly if it is a parent of such a one.

A pack hands on one row per distinct pair with its count; nothing is collected or broadcast,
and a pair has at most as many rows as there are packs.

Defined cases: a null text is empty; a null language is ``und``; repeated rows count again;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .packs import grow, numbered, packs, squeeze
from .textops import LOWER, SharedTables, give_back, spans

LEAST = 10
MOST_WORDS = 3
SHARE_PERCENT = 50
TOP = 2000
GAP = r"\x20\x09.,;:!?\x0A-\x0D"

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(10, 14)]] = True
_WORD = ~_BREAK
_WORD[[32, 9]] = False
#: A name is a pack's number and a number within it.
_CODE_BITS = 24

_FIRST = pa.schema([("pack", pa.int64()), ("code", pa.int32()), ("n", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("seq", pa.binary()), ("own", pa.binary())])
_NEXT = pa.schema([("pack", pa.int64()), ("code", pa.int32()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("seq", pa.binary()), ("own", pa.binary())])


def _rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A batch of ``schema`` in which columns not given are null and single values repeat."""
    n = max(len(c) for c in columns.values() if hasattr(c, "__len__") and not isinstance(c, bytes))
    made = []
    for f in schema:
        c = columns.get(f.name)
        made.append(pa.nulls(n, f.type) if c is None else pa.array(c, f.type) if isinstance(c, (list, np.ndarray)) else c if isinstance(c, pa.Array) else pa.repeat(pa.scalar(c, f.type), n))
    return pa.RecordBatch.from_arrays(made, schema=schema)


def _numbers(key: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys below ``most`` in order, and the number of each key among them; a table of all keys saves a sort where it is no larger than its input."""
    if most > 8 * len(key):
        kinds, code = np.unique(key, return_inverse=True)
        return kinds, code.astype(np.int32)
    number = np.zeros(most, np.int32)
    number[key] = 1
    kinds = np.flatnonzero(number)
    number[kinds] = np.arange(len(kinds), dtype=np.int32)
    return kinds, number[key]


def _first(batches: Iterator[pa.RecordBatch], most_words: int) -> Iterator[pa.RecordBatch]:
    """(text, lang) in; out: the words of each pack with their numbers and counts, how many a language has, and its texts as numbers."""
    for number, pack in numbered(packs(batches, GAP, most_words - 1), TaskContext.get().partitionId()):
        low = LOWER[pack.raw]
        mask = _WORD[low]
        start, end = spans(mask, pack.offsets)
        if not len(start):
            continue
        row = (np.searchsorted(pack.offsets, start, side="right") - 1).astype(np.int32)
        edges = np.concatenate([[0], np.cumsum(end - start)])
        words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(edges), pa.py_buffer(low[mask])]).dictionary_encode()
        del mask, edges
        langs = pack.rows.column("lang").combine_chunks().dictionary_encode()
        own = start - pack.offsets[row] < pack.own[row]
        # a text ends, or a break stands before the word
        gap = np.flatnonzero((row[1:] != row[:-1]) | np.logical_or.reduceat(_BREAK[low], np.append(end[:-1], start[1:]).reshape(2, -1).T.ravel())[::2]) + 1 if len(start) > 1 else np.zeros(0, np.int64)
        del low, start, end
        size = len(words.dictionary)
        key = langs.indices.to_numpy()[row].astype(np.int64) * size + words.indices.to_numpy()
        del row
        kinds, code = _numbers(key, len(langs.dictionary) * size)
        del key
        count = np.bincount(code, weights=own, minlength=len(kinds)).astype(np.int64)
        found = _rows(_FIRST, pack=number, code=np.arange(len(kinds), dtype=np.int32), n=count, lang=langs.dictionary.take(pa.array(kinds // size)), word=words.dictionary.take(pa.array(kinds % size)).cast(pa.large_string()).cast(pa.string()))
        own_words = np.bincount(kinds // size, weights=count, minlength=len(langs.dictionary)).astype(np.int64)
        del words, kinds, count
        yield found
        del found
        yield _rows(_FIRST, pack=number, n=own_words, lang=langs.dictionary)
        seq, own = squeeze(np.insert(code, gap, -1)), np.packbits(np.insert(own, gap, False)).tobytes()
        del code, gap, pack
        yield _rows(_FIRST, pack=number, lang=[f"{number}"], seq=[seq], own=[own])
        del seq, own
        give_back()


def _pairs(texts: pa.Table, names: pa.Table) -> pa.Table:
    """A pack's texts as numbers and the names of those; out: its pairs of neighbouring names, counted and numbered, and its texts as such numbers."""
    if not texts.num_rows or not names.num_rows:
        return _NEXT.empty_table()
    seq = grow(texts.column("seq")[0].as_py(), np.int32)
    own = np.unpackbits(np.frombuffer(texts.column("own")[0].as_py(), np.uint8), count=len(seq)).astype(bool)
    code, name = names.column("code").to_numpy(), names.column("name").to_numpy()
    called = np.full(max(int(seq.max(initial=0)), int(code.max())) + 2, -1, np.int64)  # the last place is for gaps
    called[code] = np.arange(len(code))
    seq = called[seq]
    at = np.flatnonzero((seq[:-1] >= 0) & (seq[1:] >= 0))
    kinds, made = np.unique(seq[at] * len(code) + seq[at + 1], return_inverse=True)
    if not len(kinds):
        return _NEXT.empty_table()
    count = np.bincount(made, weights=own[at], minlength=len(kinds)).astype(np.int64)
    after = np.full(len(seq), -1, np.int32)
    after[at] = made
    del at, made, called, seq
    pack = texts.column("pack")[0].as_py()
    rows = _rows(_NEXT, pack=pack, code=np.arange(len(kinds), dtype=np.int32), n=count, a=name[kinds // len(code)], b=name[kinds % len(code)])
    text = _rows(_NEXT, pack=pack, a=[pack], seq=[squeeze(after)], own=[np.packbits(own).tobytes()])
    del after, own, kinds, count, code, name
    give_back()
    return pa.Table.from_batches([rows, text])


def _named(parts: DataFrame, by: list[str], least: int) -> DataFrame:
    """Packs' numbers with the name and the count that all packs' equal ones share; rarer ones go, rows without a number pass."""
    same = Window.partitionBy(*by)
    place = F.shiftleft("pack", _CODE_BITS).bitwiseOR(F.col("code").cast("bigint"))
    return parts.withColumn("f", F.sum("n").over(same)).withColumn("name", F.min(place).over(same)).withColumn("first", F.col("name") == place).where(f"code is null or f >= {least}")


def _nodes(found: DataFrame, shorter: DataFrame | None) -> DataFrame:
    """(name, lang, phrase, last, f, pre, suf) of each named phrase: ``pre`` and ``suf`` are the counts of its first and last 1, 2, .. words."""
    if shorter is None:
        none = F.array().cast("array<bigint>")
        return found.where("first").select("name", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", none.alias("pre"), none.alias("suf"))
    a = shorter.select(F.col("name").alias("a"), "lang", F.col("phrase").alias("head"), F.col("pre").alias("a_pre"), F.col("f").alias("a_f"))
    b = shorter.select(F.col("name").alias("b"), "last", F.col("suf").alias("b_suf"), F.col("f").alias("b_f"))
    grown = lambda counts, f: F.concat(counts, F.array(f))
    return found.select("name", "a", "b", "f").join(a, "a").join(b, "b").select("name", "a", "b", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "f", grown(F.col("a_pre"), F.col("a_f")).alias("pre"), grown(F.col("b_suf"), F.col("b_f")).alias("suf"))


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (l * r)), exact: counts of up to 15 digits make a dividend of at most 37, and ``div`` does not round."""
    wide = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(left) * wide(right))


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST, most_words: int = MOST_WORDS, share_percent: int = SHARE_PERCENT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of 2 to ``most_words`` words of each language."""
    kept = SharedTables(docs.sparkSession)
    base = docs.select(F.col(text).alias("body"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang")).where("octet_length(body) > 0")
    made = base.mapInArrow(lambda it: _first(it, most_words), "pack bigint, code int, n bigint, lang string, word string, seq binary, own binary")
    words = _named(made, ["lang", "word"], least)
    told = F.col("first") | F.col("code").isNull()
    words = kept.store(words.select("pack", "code", "name", "f", "first", "n", F.when(told, F.col("lang")).alias("lang"), F.when(told, F.col("word")).alias("word"), "seq", "own"), large=True)
    total = words.where("code is null and seq is null").groupBy("lang").agg(F.sum("n").alias("n"))
    texts, named = words.where("seq is not null").select("pack", "seq", "own"), words.where("code is not null")
    nodes = [_nodes(named, None)]
    for size in range(2, most_words + 1):
        pairs = texts.groupBy("pack").cogroup(named.select("pack", "code", "name").groupBy("pack")).applyInArrow(_pairs, "pack bigint, code int, n bigint, a bigint, b bigint, seq binary, own binary")
        if size == most_words:
            found = pairs.where("seq is null").groupBy("a", "b").agg(F.sum("n").alias("f")).where(f"f >= {least}").withColumn("name", F.lit(None).cast("bigint"))
            nodes.append(kept.store(_nodes(found, nodes[-1]), large=True))
        else:
            level = kept.store(_named(pairs, ["a", "b"], least).select("pack", "code", "name", "f", "first", F.when(F.col("first"), F.col("a")).alias("a"), F.when(F.col("first"), F.col("b")).alias("b"), "seq", "own"), large=True)
            texts, named = level.where("seq is not null").select("pack", "seq", "own"), level.where("seq is null")
            nodes.append(kept.store(_nodes(named.where("first"), nodes[-1])))
    out = None
    for size, level in enumerate(nodes[1:], 2):
        if size < most_words:
            longer = nodes[size].select(F.col("a").alias("part"), F.col("f").alias("in_f")).unionAll(nodes[size].select(F.col("b"), F.col("f"))).groupBy("part").agg(F.max("in_f").alias("in_f"))
            level = level.join(longer, level["name"] == longer["part"], "left").where(f"in_f is null or 100 * in_f < {share_percent} * f")
        cuts = F.array_min(F.array(*(F.struct(_score(F.col("f"), F.col("pre")[k - 1], F.col("suf")[size - k - 1]).alias("score"), F.lit(k).alias("k"), F.col("pre")[k - 1].alias("l"), F.col("suf")[size - k - 1].alias("r")) for k in range(1, size))))
        level = level.select("lang", "phrase", F.col("f").alias("a"), cuts.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        out = level if out is None else out.unionAll(level)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH p AS (SELECT lang, piece, row_number() OVER () AS id FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), w AS (SELECT id, lang, unnest(w) AS x, unnest(range(len(w))) AS i FROM (SELECT id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p)
), x AS (SELECT lang, x, x || ' ' || lead(x) OVER o AS x2, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o AS x3 FROM w WINDOW o AS (PARTITION BY id ORDER BY i)
), g AS (SELECT lang, m, s, count(*) AS f FROM (SELECT lang, 1 AS m, x AS s FROM x UNION ALL SELECT lang, 2, x2 FROM x UNION ALL SELECT lang, 3, x3 FROM x) WHERE s IS NOT NULL GROUP BY ALL
), n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE m = 1 GROUP BY lang
), c AS (SELECT lang, m, s, f AS a, string_split(s, ' ') AS w FROM g WHERE m > 1 AND f >= 10
), cut AS (SELECT c.*, k, array_to_string(list_slice(w, 1, k), ' ') AS x, array_to_string(list_slice(w, k + 1, m), ' ') AS y FROM c, (VALUES (1), (2)) v(k) WHERE k < m
), sc AS (SELECT cut.*, gl.f AS l, gr.f AS r, (1000000::HUGEINT * a * a // (gl.f::HUGEINT * gr.f))::BIGINT AS score FROM cut JOIN g gl ON gl.lang = cut.lang AND gl.s = x JOIN g gr ON gr.lang = cut.lang AND gr.s = y
  QUALIFY row_number() OVER (PARTITION BY cut.lang, cut.s ORDER BY score, k) = 1
), inner2 AS (SELECT lang, part, max(a) AS longer FROM (SELECT lang, w[1] || ' ' || w[2] AS part, a FROM c WHERE m = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE m = 3) GROUP BY ALL
)
SELECT sc.lang, row_number() OVER (PARTITION BY sc.lang ORDER BY score DESC, a DESC, s) AS rank, s AS phrase, a, l, r, n, score
FROM sc JOIN n ON n.lang = sc.lang LEFT JOIN inner2 i ON i.lang = sc.lang AND i.part = sc.s
WHERE longer IS NULL OR 100 * longer < 50 * a QUALIFY rank <= 2000
"""

__all__ = ["collocations"]
