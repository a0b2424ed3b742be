"""Line dedup as an exact set-similarity join, with DataFrame functions only.

A line is its set of words (lower-cased, split at ASCII punctuation and space). A line is removed when an earlier line, in the order of
(doc_id, line number), has a word set with Jaccard similarity at or over the
threshold. Earlier lines count whether or not they are removed themselves, so the
result does not depend on any processing order.

1. Words are ordered by rarity: counts over all lines, in a table of a fixed
   number of hash slots (rarity only steers the order; any order is correct).
2. Lines with the same set collapse to their first line; copies go.
3. The first |x| - ceil(t |x|) + 1 words of each distinct line are its prefix.
   Lines meet on (prefix word, length class), under length, positional and
   bitmap filters, each of which only drops pairs that cannot reach t.
4. First every line meets two lines of each of its groups, the earliest and the one
   with most copies, and the two best of those are verified (linear in the group, and
   a group of a frequent word is split, so that none is gathered in one task); pairs
   whose later line that settles are not looked at again.
5. Surviving pairs are verified on the words themselves.

Defined cases: a null text stays null, an empty one empty; lines without a word
are never removed; rows with one doc_id are repeats of one row; rows with a null
doc_id are left as they are and match nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .textops import SharedTables, unused

THRESHOLD = 0.8
#: Hash slots of the rarity table: its size, whatever the vocabulary.
SLOTS = 1 << 20
#: Parts in which prefix words are joined, one after the other.
TURNS = 4
#: From this rank on, that is from about 16,000 lines with a word, a group is split; a part has about so many lines.
SPLIT_RANK = 57
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(line), _GAP), "")


def _lines(docs: DataFrame) -> DataFrame:
    return docs.where("id is not null and body is not null").select("id", F.posexplode(F.split("body", "\n")).alias("line_no", "line"))


def rarity(docs: DataFrame) -> bytes:
    """For each hash slot one byte, 1 to 125: four times the binary logarithm of the words that fall in it."""
    slot = F.xxhash64("word").bitwiseAND(F.lit(SLOTS - 1)).cast("int")
    counts = docs.select(F.explode(F.split(F.lower("body"), _GAP)).alias("word")).where("word <> ''").groupBy(slot.alias("slot")).agg(F.least(F.lit(124), F.floor(4 * F.log2(F.count("*")))).cast("int").alias("rank"))
    every = docs.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("slot")).join(counts, "slot", "left")
    listed = F.array_sort(F.collect_list(F.struct("slot", F.coalesce("rank", F.lit(0)).alias("rank"))))
    return every.agg(F.array_join(F.transform(listed, lambda x: F.char(x["rank"] + 1)), "").alias("ranks")).first()[0].encode("ascii")


def _parity(words: Column) -> Column:
    """64 bits, each the parity of the number of words that fall on it; sets that differ in d words differ in d bits at most."""
    bit = lambda w: F.call_function("shiftleft", F.lit(1).cast("bigint"), w.bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda s, w: s.bitwiseXOR(bit(w)))


def _least_shared(a: Column, b: Column, t: float) -> Column:
    """Words two sets of these sizes must share."""
    return F.ceil((a + b) * F.lit(t / (1 + t)) - 1e-9)


def _may_match(a: str, b: str, t: float) -> Column:
    """Length, positional and bitmap filter for an index entry of an earlier line ``a`` and a later ``b``."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    p, q = F.col(f"{a}.pos"), F.col(f"{b}.pos")
    need = _least_shared(n, m, t)
    most = F.least(p, q) + 1 + F.least(n - p - 1, m - q - 1)
    differ = F.bit_count(F.col(f"{a}.even").bitwiseXOR(F.col(f"{b}.even"))) + F.bit_count(F.col(f"{a}.odd").bitwiseXOR(F.col(f"{b}.odd")))
    return (F.least(n, m) >= F.ceil(F.greatest(n, m) * t - 1e-9)) & (most >= need) & (differ <= n + m - 2 * need)


def _flat(pairs: DataFrame) -> DataFrame:
    """One row for each prefix word that two lines share, with what is left of the shorter after it."""
    rest = F.least(F.col("a.n") - F.col("a.pos") - 1, F.col("b.n") - F.col("b.pos") - 1)
    return pairs.select(F.col("b.id").alias("b_id"), F.col("b.line_no").alias("b_no"), F.col("a.id").alias("a_id"), F.col("a.line_no").alias("a_no"), F.col("a.n").alias("a_n"), F.col("b.n").alias("b_n"), rest.alias("rest"))


def _bounded(flat: DataFrame, t: float) -> DataFrame:
    """Pairs of lines whose shared prefix words, and what is left after the last of them, can make up the overlap."""
    met = flat.groupBy("b_id", "b_no", "a_id", "a_no", "a_n", "b_n").agg(F.count("*").alias("k"), F.min("rest").alias("rest"))
    return met.where(F.col("k") + F.col("rest") >= _least_shared(F.col("a_n"), F.col("b_n"), t)).select("b_id", "b_no", "a_id", "a_no", "k")


def _verified(pairs: DataFrame, docs: DataFrame, t: float, kept: SharedTables) -> DataFrame:
    """The later lines (id, line_no) of pairs whose word sets reach the threshold."""
    pairs = kept.store(pairs.select("b_id", "b_no", "a_id", "a_no"))
    wanted = pairs.select(F.explode(F.array(F.struct(F.col("a_id").alias("id"), F.col("a_no").alias("no")), F.struct(F.col("b_id").alias("id"), F.col("b_no").alias("no")))).alias("x")).groupBy(F.col("x.id").alias("wid")).agg(F.collect_set("x.no").alias("nos"))
    found = docs.join(kept.store(wanted), F.col("id") == F.col("wid")).withColumn("parts", F.split("body", "\n")).select("id", F.explode("nos").alias("line_no"), "parts")
    words = kept.store(found.select("id", "line_no", F.array_distinct(_words(F.get("parts", F.col("line_no")))).alias("words")).dropDuplicates(["id", "line_no"]), large=True)
    first = pairs.join(words.select(F.col("id").alias("b_id"), F.col("line_no").alias("b_no"), F.col("words").alias("b_words")), ["b_id", "b_no"])
    both = first.join(words.select(F.col("id").alias("a_id"), F.col("line_no").alias("a_no"), F.col("words").alias("a_words")), ["a_id", "a_no"])
    shared = F.size(F.array_intersect("a_words", "b_words"))
    total = F.size("a_words") + F.size("b_words")
    out = kept.store(both.where(shared * (1 + t) >= total * t - 1e-9).select(F.col("b_id").alias("id"), F.col("b_no").alias("line_no")).distinct())
    kept.drop(words)
    kept.drop(pairs)
    return out


def removed_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, line_no) of every line that an earlier line matches."""
    t = threshold
    kept = SharedTables(docs.sparkSession)
    base = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("body"))
    ranks = F.lit(rarity(base.where("id is not null and body is not null")))
    hashes = F.array_distinct(F.transform(_words(F.col("line")), lambda w: F.xxhash64(w)))
    rank = lambda h: F.ascii(F.substring(ranks, h.bitwiseAND(F.lit(SLOTS - 1)).cast("int") + 1, F.lit(1)).cast("string")).cast("bigint")
    token = lambda h: F.shiftleft(rank(h), 52).bitwiseOR(F.shiftrightunsigned(h, 12))
    size = F.size("words")
    stored = kept.store(
        _lines(base)
        .select("id", "line_no", F.sort_array(F.transform(hashes, token)).alias("words"))
        .select(
            "id",
            "line_no",
            size.alias("n"),
            F.xxhash64("words").alias("h1"),
            F.xxhash64(F.lit(1), "words").alias("h2"),
            _parity(F.filter("words", lambda w: w.bitwiseAND(F.lit(64)) == 0)).alias("even"),
            _parity(F.filter("words", lambda w: w.bitwiseAND(F.lit(64)) != 0)).alias("odd"),
            F.slice("words", F.lit(1), size - F.ceil(size * t - 1e-9).cast("int") + 1).alias("prefix"),
        )
    )
    lines = stored.where("n > 0")  # behind the table: in front of it the filter would work out all words once more
    firsts = kept.store(lines.groupBy("h1", "h2", "n").agg(F.min(F.struct("id", "line_no")).alias("at"), F.count("*").alias("copies"), F.first("even").alias("even"), F.first("odd").alias("odd"), F.first("prefix").alias("prefix")), large=True)
    copies = kept.store(lines.select("id", "line_no", "h1", "h2", "n").join(firsts.select("h1", "h2", "n", "at"), ["h1", "h2", "n"]).where(F.struct("id", "line_no") != F.col("at")).select("id", "line_no"))
    kept.drop(stored)
    if t >= 1:
        return copies
    # {n words} and the same with one more reach t from n = t / (1 - t) on; smaller sets only match themselves
    least = math.floor(t / (1 - t) + 1e-9)
    kind = F.floor(F.log("n") / F.lit(-math.log(t)) + 1e-9).cast("int")
    # a group of a frequent word is split by the lines' documents: each part has heads of its own
    doublings = F.greatest(F.lit(0), F.floor((F.shiftrightunsigned("word", 52) - SPLIT_RANK) / 4) + 1).cast("int")
    part = F.xxhash64("at.id").bitwiseAND(F.call_function("shiftleft", F.lit(1), doublings).cast("bigint") - 1).cast("int")
    line = F.struct(F.col("at.id").alias("id"), F.col("at.line_no").alias("line_no"), "n", "pos", "even", "odd")
    entries = firsts.where(F.col("n") >= least).select("n", "at", "copies", "even", "odd", F.posexplode("prefix").alias("pos", "word")).select("word", (part * 1024 + kind).alias("kind"), "copies", line.alias("b"))
    # of each group two lines are tried first: the earliest, and the one with most copies
    group = Window.partitionBy("word", "kind")
    often = F.struct("copies", (-F.col("b.id")).alias("id"), (-F.col("b.line_no")).alias("no"), "b")
    headed = entries.withColumn("many", F.count("*").over(group)).withColumn("heads", F.array_distinct(F.array(F.min("b").over(group), F.max(often).over(group)["b"]))).where("many > 1")
    earlier = F.expr("a.id < b.id or (a.id = b.id and a.line_no < b.line_no)")
    tried = _bounded(_flat(headed.select("b", F.explode("heads").alias("a")).where(earlier & _may_match("a", "b", t))), t)
    best = Window.partitionBy("b_id", "b_no").orderBy(F.desc("k"), "a_id", "a_no")
    easy = _verified(tried.withColumn("place", F.row_number().over(best)).where("place <= 2"), base, t, kept)
    # the rest: every pair whose later line is still open. It is joined by a merge, as what is settled grows with the input
    settled = easy.select(F.struct("id", "line_no").alias("s")).hint("merge")
    flagged = firsts.where(F.col("n") >= least).select("at", "n", "even", "odd", "prefix").join(settled, F.col("at") == F.col("s"), "left")
    flagged = kept.store(flagged.select("at", "n", "even", "odd", "prefix", F.col("s").isNull().alias("open")), large=True)
    kept.drop(firsts)
    marked = flagged.select("n", "at", "even", "odd", "open", F.posexplode("prefix").alias("pos", "word")).select("word", line.alias("x"), "open")
    # of two lines the shorter is found by its first |x| - ceil(2t / (1 + t) |x|) + 1 words
    short = F.col("x.pos") < F.col("x.n") - F.ceil(F.col("x.n") * (2 * t / (1 + t)) - 1e-9) + 1
    first = F.expr("x.id < y.id or (x.id = y.id and x.line_no < y.line_no)")
    ordered = F.expr("x.n < y.n") | (F.expr("x.n = y.n") & first)
    wanted = F.when(first, F.col("y_open")).otherwise(F.col("x_open"))
    # prefix words are taken in turns, so that only a part of both sides is in shuffle files at a time
    flat = None
    for turn in range(TURNS):
        mine = marked.where(F.pmod(F.xxhash64("word", F.lit(3)), F.lit(TURNS)) == turn)
        index = mine.where(short).withColumnRenamed("open", "x_open")
        probe = mine.select("word", F.col("x").alias("y"), F.col("open").alias("y_open"))
        pairs = index.join(probe, "word").where(ordered & wanted & _may_match("x", "y", t))
        part = kept.store(_flat(pairs.select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("b"))), large=True)
        flat = part if flat is None else flat.unionByName(part)
    kept.drop(flagged)
    rest = _verified(_bounded(flat, t), base, t, kept)
    return copies.unionByName(easy).unionByName(rest)


def drop_repeated_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, counts: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with the text of each row less its removed lines; ``counts`` names columns for lines had and removed."""
    gone_id, lines = unused(docs, "gone_id", "gone_lines")
    gone = removed_lines(docs, doc_id=doc_id, text=text, threshold=threshold).groupBy("id").agg(F.collect_set("line_no").alias(lines))
    gone = SharedTables(docs.sparkSession).store(gone.withColumnRenamed("id", gone_id))
    joined = docs.join(gone, docs[doc_id] == gone[gone_id], "left")
    parts = F.split(F.col(text), "\n")
    left = F.transform(F.filter(F.transform(parts, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda p: ~F.array_contains(lines, p["i"])), lambda p: p["x"])
    new = F.when(F.col(gone_id).isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))
    made = [new.alias(c) if c == text else docs[c] for c in docs.columns if not counts or c not in counts]
    if counts:
        made += [F.when(F.col(text).isNull(), 0).otherwise(F.size(parts)).cast("bigint").alias(counts[0]), F.coalesce(F.size(lines), F.lit(0)).cast("bigint").alias(counts[1])]
    return joined.select(*made)


def line_report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed and the kept text."""
    return drop_repeated_lines(docs.select(doc_id, text), doc_id=doc_id, text=text, counts=("n_lines", "n_removed")).select(doc_id, "n_lines", "n_removed", F.col(text).alias("kept"))


__all__ = ["drop_repeated_lines", "line_report", "rarity", "removed_lines"]
