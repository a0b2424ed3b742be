"""Reading original evidence: hybrid recall over units of regions, views with neighbours, and checks that nothing is stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import trees

RRF = 60
#: Candidates of a channel: the bound of what recall looks at.
CHANNEL = 1000


def _channel(ranked: DataFrame, order: list[Column], nodes: DataFrame, name: str) -> DataFrame:
    """(parent, place, node) of one channel: its best candidates, collapsed to the first of each parent.

    Knowledge that no one reviewed takes no place. At most ``CHANNEL`` rows are ordered in one task.
    """
    top = ranked.orderBy(*order).limit(CHANNEL)
    # bounded by ``CHANNEL``: the nodes stay where they are
    placed = F.broadcast(top.withColumn("r", F.row_number().over(Window.orderBy(*order))).select("id", "r")).join(nodes, "id")
    open_ = placed.where((F.col("kind") != "knowledge") | (F.col("review_state") == "reviewed"))
    first = open_.groupBy("parent").agg(F.min("r").alias("r"), F.min_by(F.struct("id", "kind"), "r").alias("node"))
    return first.select("parent", F.row_number().over(Window.orderBy("r")).alias("place"), "node", F.lit(name).alias("channel"))


def hybrid(nodes: DataFrame, lexical: DataFrame, semantic: DataFrame, wanted: list[str], limit: int) -> DataFrame:
    """What a query recalls: (position, parent, node_id, score, lexical_place, semantic_place, outcome).

    ``nodes`` is (id, kind, parent, words, review_state, stale); ``lexical`` (id, rank), less is better; ``semantic``
    (id, score). Units stand for their parents; channels are fused by reciprocal rank; the parent of the best semantic hit
    comes first, then by score, ties by parent. A hit of words alone must share one with the query. ``outcome`` is
    ``result`` for the first ``limit`` that are current and ``gap`` for stale ones among them.
    """
    lean = nodes.select("id", "kind", "parent", "review_state")
    by_word = _channel(lexical, [F.col("rank"), F.col("id")], lean, "lexical")
    by_sense = _channel(semantic, [F.desc("score"), F.desc("id")], lean, "semantic")
    of = lambda name, c: F.max(F.when(F.col("channel") == name, F.col(c)))
    both = by_word.unionByName(by_sense).groupBy("parent").agg(F.sum(1.0 / (RRF + F.col("place"))).alias("score"), *[of(n, "place").alias(f"{n}_place") for n in ("lexical", "semantic")], of("lexical", "node").alias("by_word"), of("semantic", "node").alias("by_sense"))
    node = F.when(F.col("by_sense.kind") == "retrieval-unit", F.col("by_sense.id")).otherwise(F.coalesce("by_word.id", "by_sense.id"))
    fused = both.select("parent", F.round("score", 12).alias("score"), "lexical_place", "semantic_place", node.alias("node_id"))
    told = F.broadcast(fused).join(nodes.select(F.col("id").alias("node_id"), "kind", "words", "stale"), "node_id")
    shares = F.arrays_overlap("words", F.array(*[F.lit(w) for w in wanted])) if wanted else F.lit(False)
    fair = told.where(F.col("semantic_place").isNotNull() | (F.col("kind") == "knowledge") | shares)
    order = Window.orderBy(F.coalesce(F.col("semantic_place") != 1, F.lit(True)), F.desc("score"), "parent")
    ordered = fair.withColumn("position", F.row_number().over(order)).withColumn("good", F.sum((~F.col("stale")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept = ordered.where((F.col("good") < limit) | ((F.col("good") == limit) & ~F.col("stale")))
    return kept.select("position", "parent", "node_id", "score", "lexical_place", "semantic_place", F.when(F.col("stale"), "gap").otherwise("result").alias("outcome"))


def region_faults(stored: DataFrame, current: DataFrame, sources: DataFrame) -> DataFrame:
    """(doc_id, region, fault): null where a stored region still is what its source says.

    ``stored`` and ``current`` are regions (doc_id, region, region_text, before, after) as stored and as cut from the sources
    today; ``sources`` is (doc_id, was, now), hashes of the whole. Both cuts meet piece by piece: no text is searched.
    """
    # what is compared moves as 128 bits of sha256 of the text, and of both contexts with their lengths
    digest = lambda c: F.substring(F.unhex(F.sha2(c, 256)), 1, 16)
    before, after = (F.coalesce(F.col(c), F.lit("")) for c in ("before", "after"))
    around = F.concat(F.length(before).cast("string"), F.lit(":"), before, after)
    held = lambda rows, name: rows.select("doc_id", "region", F.struct(digest(F.col("region_text")).alias("text"), digest(around).alias("around")).alias(name))
    both = held(stored, "then").join(held(current, "now"), ["doc_id", "region"], "left")
    # the fault of a region is found before the hashes of the whole are joined, so that only faults move again
    own = F.when(F.col("now").isNull(), "offsets").when(F.col("now.text") != F.col("then.text"), "text-differs").when(F.col("now.around") != F.col("then.around"), "context-differs")
    told = both.select("doc_id", "region", own.alias("own")).join(sources, "doc_id", "left")
    fault = F.when(F.col("was").isNull() | F.col("now").isNull(), "unknown-source").when(F.col("was") != F.col("now"), "source-changed").otherwise(F.col("own"))
    return told.select("doc_id", "region", fault.alias("fault"))


def neighbourhood(regions: DataFrame, reach: int) -> DataFrame:
    """(source_id, id, neighbours): ids of the regions of the same source at most ``reach`` places away, in order."""
    w = Window.partitionBy("source_id").orderBy("region_index")
    beside = [F.lag("id", k).over(w) for k in range(reach, 0, -1)] + [F.lead("id", k).over(w) for k in range(1, reach + 1)]
    return regions.select("source_id", "id", F.array_compact(F.array(*beside)).alias("neighbours"))


def current_links(links: DataFrame, nodes: DataFrame, most: int = 3) -> DataFrame:
    """(id, other, cosine): similarity links whose both ends still have the fingerprints they were made with.

    Links count for either end; of several between two regions the best does; at most ``most`` an end, by cosine, then id.
    """
    now = nodes.select("id", "fingerprint")
    live = links
    for side in ("src", "dst"):
        live = live.join(now.select(F.col("id").alias(side), F.col("fingerprint").alias(f"{side}_fp")), [side, f"{side}_fp"], "left_semi")
    ends = live.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other")))).alias("e"), "cosine").select("e.*", "cosine")
    best = ends.groupBy("id", "other").agg(F.max("cosine").alias("cosine"))
    return best.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other"))).where(F.col("n") <= most).drop("n")


def sections(headings: DataFrame, last_page: DataFrame) -> DataFrame:
    """(source_id, ord, level, title, first_page, last_page, parent): the ranges of an outline.

    A section ends where the next heading of its level or a lower one begins, at the last page of the source otherwise;
    its parent is the nearest earlier heading of a lower level. Headings are (source_id, ord, level, title, page), of any depth; a source may have any number.
    """
    placed = trees.sections(headings, "source_id", "ord", "level").join(last_page, "source_id")
    starts = headings.select("source_id", F.col("ord").cast("bigint").alias("ends"), F.col("page").alias("until"))
    end = F.greatest(F.col("page"), F.coalesce("until", F.col("pages")))
    return placed.join(starts, ["source_id", "ends"], "left").select("source_id", "ord", "level", "title", F.col("page").alias("first_page"), end.alias("last_page"), F.col("parent").cast("int").alias("parent"))


def anchored_claims(claims: DataFrame, regions: DataFrame) -> DataFrame:
    """(claim, fault): null where a claim's quote stands in the region it names, which exists and is current.

    ``claims`` is (claim, region_id, quote), ``regions`` (id, text, stale).
    """
    both = claims.join(regions, F.col("region_id") == F.col("id"), "left")
    fault = F.when(F.col("id").isNull(), "unknown-region").when(F.col("stale"), "stale-region").when(F.coalesce(F.trim("quote"), F.lit("")) == "", "no-quote").when(~F.contains("text", "quote"), "quote-not-found")
    return both.select("claim", fault.alias("fault"))
