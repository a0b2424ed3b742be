"""N-gram Jaccard join: MinHash banding, then verification on full n-gram sets.

1. One pass over the texts makes, per document, a fingerprint of its n-gram set
   and its band keys. Documents with one set form a class of copies; only the
   class's smallest id goes on. Sketches are written to the shared folder.
2. A shuffle on band keys finds, per key, the smallest id (the pivot) and links
   each member to its pivots. That is linear in a bucket's size: pairs inside a
   bucket are never emitted.
3. Each member is compared with its pivots' texts once and goes on as the set
   difference to the pivot. For two members x, y of pivot P,
   |x & y| = |P| - |x-| - |y-| + |Dx & Dy|, so the Jaccard similarity of the
   full sets of every two members follows exactly from small differences.
4. Members of a pivot are dealt into tiles of two blocks of bounded size; a tile
   verifies its pairs in memory and returns counts and local components only.
   A pair with several common pivots is counted at the smallest.
5. Connected components by alternating large-star and small-star rounds.

Defined cases: null or empty texts are linked to nothing and form classes of
their own; a text of fewer words than n has one n-gram, all its words; rows with
one id are one document; rows with a null id get class_id null and no links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import MULT, SharedTables, Words, append_columns, ensure_checkpoint_dir, mix, ngram_hash, slices, string_bytes, unused

N, THRESHOLD, RECALL = 5, 0.8, 0.999
#: Members in a block; a tile holds two.
BLOCK = 1024


def choose_bands(threshold: float, recall: float, most: int = 96) -> tuple[int, int]:
    """Bands and rows: the most selective rows for which pairs at the threshold meet with the wanted probability."""
    best = None
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError("this recall needs more hashes")
    return best


def gram_sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All n-gram hashes of the rows end to end, and where each row's begin (with repeats)."""
    w = Words(raw, offsets)
    grams, at = ngram_hash(w, n)
    row = w.row[at]
    size = np.diff(w.first)
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        for k in range(n):
            has = size[short] > k
            own[has] = own[has] * MULT + w.hash[w.first[short[has]] + k] + np.uint64(k + 1)
        grams, row = np.concatenate([grams, mix(own)]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        grams, row = grams[order], row[order]
    return grams, np.searchsorted(row, np.arange(len(offsets)))


def _sketch(column: pa.Array, n: int, bands: int, rows: int) -> list[pa.Array]:
    rng = np.random.default_rng(5)
    a = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(1, 2**63, bands * rows, dtype=np.uint64)
    raw, offsets = string_bytes(column)
    count, first_hash, second_hash, keys = [], [], [], []
    for lo, hi in slices(offsets):
        grams, first = gram_sets(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], n)
        full = np.flatnonzero(np.diff(first))
        size, x, y = (np.zeros(hi - lo, t) for t in (np.int32, np.uint64, np.uint64))
        for r in full.tolist():
            own = np.unique(grams[first[r] : first[r + 1]])
            size[r], x[r], y[r] = len(own), own.sum(), mix(own).sum()
        band = np.zeros((hi - lo, bands), np.uint64)
        if len(full):
            for k in range(bands):
                key = np.full(len(full), k, np.uint64)
                for j in range(k * rows, (k + 1) * rows):
                    key = key * MULT + np.minimum.reduceat(grams * a[j] + b[j], first[full])
                band[full, k] = mix(key)
        count.append(size)
        first_hash.append(x)
        second_hash.append(y)
        keys.append(band)
    cat = lambda v, t: np.concatenate(v).view(t) if v else np.zeros(0, t)
    size = cat(count, np.int32)
    flat = np.concatenate(keys).view(np.int64)[size > 0].ravel() if keys else np.zeros(0, np.int64)
    at = np.concatenate([[0], np.cumsum((size > 0) * bands)]).astype(np.int32)
    return [pa.array(size), pa.array(cat(first_hash, np.int64)), pa.array(cat(second_hash, np.int64)), pa.ListArray.from_arrays(at, pa.array(flat))]


def _differences(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own, pivot = (string_bytes(batch.column(batch.schema.get_field_index(c))) for c in ("member_text", "pivot_text"))
        minus, n_pivot, n_minus, n_own = [], [], [], []
        # both sides are cut at the same rows
        for a, b in slices(own[1] + pivot[1]):
            (x, xf), (p, pf) = (gram_sets(raw[off[a] : off[b]], off[a : b + 1] - off[a], n) for raw, off in (own, pivot))
            for r in range(b - a):
                mine, its = np.unique(x[xf[r] : xf[r + 1]]), np.unique(p[pf[r] : pf[r + 1]])
                less = np.setdiff1d(its, mine, assume_unique=True)
                more = np.setdiff1d(mine, its, assume_unique=True)
                minus.append(np.concatenate([less, more]).tobytes())
                n_pivot.append(len(its))
                n_minus.append(len(less))
                n_own.append(len(mine))
        keep = [batch.column(batch.schema.get_field_index(c)) for c in ("member", "weight", "pivots", "pivot", "left", "right", "block")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(n_pivot, pa.int32()), pa.array(n_minus, pa.int32()), pa.array(n_own, pa.int32()), pa.array(minus, pa.binary())], ["member", "weight", "pivots", "pivot", "left", "right", "block", "n_pivot", "n_minus", "n_own", "difference"])


def _shared(member: np.ndarray, item: np.ndarray, n: int) -> np.ndarray:
    """How many items each two of n members share, as a matrix."""
    order = np.argsort(item, kind="stable")
    member, item = member[order], item[order]
    new = np.flatnonzero(np.diff(item, prepend=item[:1] - 1 if len(item) else 0) != 0) if len(item) else np.zeros(0, np.int64)
    size = np.diff(np.append(new, len(item)))
    out = np.zeros((n, n), np.float32)
    wide = size > max(32, n // 16)
    for part in np.array_split(np.flatnonzero(wide), max(1, -(-int(wide.sum()) // 2048))):
        if len(part):
            has = np.zeros((n, len(part)), np.float32)
            for k, i in enumerate(part.tolist()):
                has[member[new[i] : new[i] + size[i]], k] = 1
            out += has @ has.T
    for m in np.unique(size[~wide & (size > 1)]).tolist():
        rows = member[new[~wide & (size == m)][:, None] + np.arange(m)]
        for part in np.array_split(rows, max(1, -(-rows.shape[0] * m * m // 4_000_000))):
            pair = (part[:, :, None].astype(np.int64) * n + part[:, None, :]).ravel()
            out += np.bincount(pair, minlength=n * n).reshape(n, n)
    return out


def _tile(t: dict[str, list], over: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a tile: members, linked classes, linked documents and the smallest member each is connected to."""
    member, at = np.unique(np.array(t["member"], np.int64), return_index=True)
    n = len(member)
    get = lambda c: np.array(t[c], np.int64)[at]
    size, less, block, weight, base = get("n_own"), get("n_minus"), get("block"), get("weight"), t["n_pivot"][0]
    deltas = [np.frombuffer(t["difference"][i], np.uint64) for i in at.tolist()]
    common = _shared(np.repeat(np.arange(n), [len(d) for d in deltas]), np.concatenate(deltas), n)
    both = base - less[:, None] - less[None, :] + common.astype(np.int64)
    total = size[:, None] + size[None, :]
    # |x & y| / (|x| + |y| - |x & y|) >= a / b, in whole numbers
    link = both * (over.numerator + over.denominator) >= over.numerator * total
    if t["left"][0] == t["right"][0]:
        np.fill_diagonal(link, False)
    else:
        link &= block[:, None] != block[None, :]
    smaller = [[q for q in t["pivots"][i] if q < t["pivot"][0]] for i in at.tolist()]
    if any(smaller):
        _, ids = np.unique(np.array([q for s in smaller for q in s], np.int64), return_inverse=True)
        link &= _shared(np.repeat(np.arange(n), [len(s) for s in smaller]), ids, n) == 0
    label = np.arange(n)
    while True:
        best = np.minimum(label, np.where(link, label[None, :], n).min(1))
        best = best[best]
        if (best == label).all():
            break
        label = best
    return member, link.sum(1), link @ weight, member[label]


def _tiles(batches: Iterator[pa.RecordBatch], over: Fraction) -> Iterator[pa.RecordBatch]:
    """Sorted rows of tiles in, a row for each linked member of each tile out."""
    names = ["member", "texts", "documents", "label"]
    key, rows = None, None

    def done(rows: dict[str, list]) -> pa.RecordBatch:
        found = _tile(rows, over)
        keep = found[1] > 0
        return pa.RecordBatch.from_arrays([pa.array(x[keep].astype(np.int64)) for x in found], names)

    for batch in batches:
        cols = batch.to_pydict()
        keys = list(zip(cols["pivot"], cols["left"], cols["right"], strict=True))
        cuts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]] + [len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if keys[a] != key:
                if rows is not None:
                    yield done(rows)
                key, rows = keys[a], {c: [] for c in cols}
            for c in cols:
                rows[c] += cols[c][a:b]
    if rows is not None:
        yield done(rows)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of its component for every node of ``edges`` (u, v) but those smallest ones.

    Each round is two aggregations and two joins on distributed data, checkpointed; the last one changes nothing.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).checkpoint()
        # large star: greater neighbours move to the smallest of the neighbourhood
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = large.checkpoint()
        # small star: all smaller neighbours move to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m")).checkpoint()
        now = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct().checkpoint()
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    return now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id of its connected group of near-duplicates),
    copy_of (smallest id with the same n-gram set), n_links (other documents at or over the threshold),
    n_text_links (other n-gram sets at or over it)."""
    bands, rows = choose_bands(threshold, recall)
    over = Fraction(str(threshold))
    kept = SharedTables(docs.sparkSession)
    base = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("body"))
    sketch = append_columns(base, "body", lambda c: _sketch(c, n, bands, rows), "n int, h1 bigint, h2 bigint, bands array<bigint>").drop("body").checkpoint()
    known = sketch.where("id is not null and n > 0")
    classes = known.groupBy("n", "h1", "h2").agg(F.min("id").alias("copy_of"), F.count_distinct("id").alias("weight"), F.first("bands").alias("bands")).checkpoint()
    keyed = classes.select(F.col("copy_of").alias("member"), "weight", F.explode("bands").alias("key"))
    pivots = keyed.groupBy("key").agg(F.min("member").alias("pivot"), F.count("*").alias("c")).where("c > 1").drop("c").checkpoint()
    linked = keyed.join(pivots, "key").groupBy("member", "weight").agg(F.sort_array(F.collect_set("pivot")).alias("pivots"))
    linked = linked.checkpoint()
    pairs = linked.select("member", F.explode("pivots").alias("pivot"))
    sizes = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).checkpoint()
    # a member's block of each of its pivots is settled before texts move, so that no task gets all members of a pivot
    spot = F.struct("pivot", "blocks", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int").alias("block"))
    spots = pairs.join(sizes, "pivot").groupBy("member").agg(F.collect_list(spot).alias("spots"))
    # the texts of linked documents, pivots among them, are fetched once
    held = kept.store(linked.join(spots, "member").join(base.where("id is not null"), F.col("member") == F.col("id")).select("member", "weight", "pivots", "spots", "body"), large=True)
    members = held.select("member", "weight", "pivots", F.col("body").alias("member_text"), F.explode("spots").alias("spot")).select("*", "spot.pivot", "spot.block", "spot.blocks").drop("spot")
    roots = held.select(F.col("member").alias("pivot"), F.col("body").alias("pivot_text")).join(sizes, "pivot").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    compared = members.join(roots, ["pivot", "block"]).withColumns({"left": F.lit(0), "right": F.col("blocks")})
    fields = "member bigint, weight bigint, pivots array<bigint>, pivot bigint, left int, right int, block int, n_pivot int, n_minus int, n_own int, difference binary"
    compared = compared.select("member", "weight", "pivots", "pivot", "left", "right", "block", "member_text", "pivot_text")
    deltas = compared.mapInArrow(lambda it: _differences(it, n), fields)
    dealt = deltas.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("right") - 1))).withColumns({"left": F.least("block", "other"), "right": F.greatest("block", "other")}).drop("other")
    tiles = dealt.repartition("pivot", "left", "right").sortWithinPartitions("pivot", "left", "right")
    found = tiles.mapInArrow(lambda it: _tiles(it, over), "member bigint, texts bigint, documents bigint, label bigint").checkpoint()
    roots_of = connected_components(found.select(F.col("member").alias("u"), F.col("label").alias("v")))
    per = found.groupBy("member").agg(F.sum("texts").alias("texts"), F.sum("documents").alias("documents"))
    groups = (
        classes.drop("bands")
        .join(per, F.col("copy_of") == F.col("member"), "left")
        .drop("member")
        .join(roots_of, F.col("copy_of") == F.col("node"), "left")
        .select("n", "h1", "h2", "copy_of", "weight", F.coalesce("root", "copy_of").alias("root"), F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("documents", F.lit(0)).alias("documents"))
        .checkpoint()
    )
    return (
        sketch.drop("bands")
        .join(groups, ["n", "h1", "h2"], "left")
        .select(
            F.col("id").alias(doc_id),
            F.when(F.col("id").isNotNull(), F.coalesce("root", "id")).alias("class_id"),
            F.when(F.col("id").isNotNull(), F.coalesce("copy_of", "id")).alias("copy_of"),
            F.when(F.col("id").isNotNull(), F.coalesce(F.col("documents") + F.col("weight") - 1, F.lit(0))).otherwise(0).cast("bigint").alias("n_links"),
            F.when(F.col("id").isNotNull(), F.coalesce("texts", F.lit(0))).otherwise(0).cast("bigint").alias("n_text_links"),
        )
    )


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that are not the first of their group; rows without an id stay."""
    (name,) = unused(docs, "later")
    later = near_duplicates(docs, doc_id=doc_id, **options).where(F.col(doc_id) != F.col("class_id")).select(F.col(doc_id).alias(name)).distinct()
    return docs.join(later, docs[doc_id] == later[name], "left_anti")


__all__ = ["choose_bands", "connected_components", "gram_sets", "keep_one", "near_duplicates"]
