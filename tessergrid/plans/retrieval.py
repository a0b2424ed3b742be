"""Lexical, semantic and hybrid retrieval as plans over postings and vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import vectors as V
from ..operators.matching import normal_words
from ..operators.ranking import numbered
from ..session import stored

K1, B = 1.2, 0.75
RRF = 60


def postings(docs: DataFrame, doc_id: str, text: str, wanted: list[str] | None = None, unicode: bool = True) -> DataFrame:
    """(doc_id, term, tf, dl). With ``wanted``, other terms are dropped before anything is shuffled."""
    words = docs.select(F.col(doc_id).alias("doc_id"), T.tokens(F.col(text), unicode).alias("words"))
    each = words.select("doc_id", F.size("words").alias("dl"), F.explode("words").alias("term"))
    if wanted is not None:
        each = each.where(F.col("term").isin(wanted))
    return each.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def bm25(docs: DataFrame, doc_id: str, text: str, query: list[str], unicode: bool = True) -> DataFrame:
    """(doc_id, rank): BM25 with k1 = 1.2, b = 0.75, negated, so that less is better; idf has a floor of 1e-6.

    Texts are read once: each document's length and its query terms are stored, and all statistics come from those.
    A query has few terms, so their document frequencies are a row each and join by broadcast of a bounded table.
    """
    wanted = sorted(set(query))
    words = docs.select(F.col(doc_id).alias("doc_id"), T.tokens(F.col(text), unicode).alias("words"))
    read = stored(words.select("doc_id", F.size("words").alias("dl"), F.filter("words", lambda w: w.isin(wanted)).alias("hits")))
    sizes = read.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    found = read.select("doc_id", "dl", F.explode("hits").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    df = found.groupBy("term").agg(F.count("*").alias("df")).limit(len(wanted))
    stats = df.join(F.broadcast(sizes))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return found.join(F.broadcast(stats), "term").groupBy("doc_id").agg((-F.sum(weight)).alias("rank"))


def cosine(vectors: DataFrame, key: str, vector: str, query: list[float]) -> DataFrame:
    """(key, score) against one query vector; vectors without a direction take no part."""
    length = math.sqrt(sum(x * x for x in query))
    if not query or not length or not math.isfinite(length):
        raise ValueError("a query vector is finite and not zero")
    q = F.array(*[F.lit(x / length) for x in query])
    unit = V.unit(V.doubles(F.col(vector)))
    return vectors.select(F.col(key).alias("key"), unit.alias("u")).where("u is not null").select("key", V.dot(F.col("u"), q).alias("score"))


def fuse(*ranked: tuple[str, DataFrame, list[Column]], most: int = 1000) -> DataFrame:
    """(id, rrf, channels): reciprocal-rank fusion of ranked lists (name, rows with ``id``, order); ties by id."""
    parts = []
    for name, rows, order in ranked:
        # an id counts where it first comes
        top = rows.orderBy(*order).limit(most)
        placed = top.withColumn("r", F.row_number().over(Window.orderBy(*order))).groupBy("id").agg(F.min("r").alias("r"))
        dense = placed.withColumn("r", F.row_number().over(Window.orderBy("r")))
        parts.append(dense.select("id", (1.0 / (RRF + F.col("r"))).alias("s"), F.lit(name).alias("channel")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("id").agg(F.sum("s").alias("rrf"), F.array_sort(F.collect_set("channel")).alias("channels"))


def field_search(docs: DataFrame, doc_id: str, fields: dict[str, str], query: list[str], unicode: bool = True) -> DataFrame:
    """(doc_id, specificity, <field>_terms ...): distinct query terms per field group, and how rare those of the whole are."""
    n = docs.agg(F.count("*").alias("n"))
    wanted = sorted(set(query))
    hits = None
    for name, column in fields.items():
        each = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.array_intersect(T.tokens(F.col(column), unicode), F.array(*[F.lit(w) for w in wanted]))).alias("term"), F.lit(name).alias("field"))
        hits = each if hits is None else hits.unionByName(each)
    per = hits.groupBy("doc_id", "term").agg(*[F.max((F.col("field") == f).cast("int")).alias(f) for f in fields])
    df = per.groupBy("term").agg(F.count("*").alias("df")).limit(len(wanted)).join(F.broadcast(n)).select("term", F.log1p(F.col("n") / (1 + F.col("df"))).alias("w"))
    return per.join(F.broadcast(df), "term").groupBy("doc_id").agg(F.sum("w").alias("specificity"), *[F.sum(f).alias(f"{f}_terms") for f in fields])


#: Fields that teach, that are titles, and that only label; all others are official.
SOURCE_FIELDS, TITLE_FIELDS = ("title", "course_title", "description", "description_variants"), ("title", "course_title")
FACET_FIELDS = ("academic_areas", "discovery_academic_areas", "expertise_tags")


def discover(fields: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Of (course_id, field, text): seven scores of the courses that have a word of the query, and their ``place`` by them.

    specificity (how rare the query words of its teaching fields are, generic ones apart), source_terms, field_terms (most in one
    field), phrase (the whole query stands in one), title_terms, official_terms, facet_terms; all descending, then the id.
    Only words of the query are counted, and only rows with one are shuffled; texts are read for words once, and once more for the
    number of courses. With ``limit`` only the first are returned; without, places are numbered by range.
    """
    asked = [w for w in normal_words(query) if w not in T.PLAN_STOP_WORDS]
    wanted = F.array(*[F.lit(w) for w in sorted(set(asked))]).cast("array<string>")
    stops = F.array(*[F.lit(w) for w in T.PLAN_STOP_WORDS])
    words = F.filter(T.normal_forms(T.tokens(F.col("text"))), lambda w: ~F.array_contains(stops, w))
    n = fields.agg(F.count_distinct("course_id").alias("n"))
    read = fields.select("course_id", "field", words.alias("words")).select("*", F.array_intersect(wanted, "words").alias("found")).where(F.size("found") > 0)
    kind = F.when(F.col("field").isin(*SOURCE_FIELDS), "source").when(F.col("field").isin(*FACET_FIELDS), "facet").otherwise("official")
    phrase = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).contains(f" {' '.join(asked)} ") if len(asked) > 1 else F.lit(False)
    told = read.select("course_id", kind.alias("kind"), F.col("field").isin(*TITLE_FIELDS).alias("title"), "found", phrase.alias("phrase"))
    per = stored(told.groupBy("course_id").agg(
        *[F.array_distinct(F.flatten(F.collect_list(F.when(F.col("kind") == k, F.col("found"))))).alias(k) for k in ("source", "official", "facet")],
        F.max(F.when(F.col("kind") == "source", F.size("found"))).alias("field_terms"),
        F.max(F.when(F.col("kind") == "source", F.col("phrase").cast("int"))).alias("phrase"),
        F.max(F.when(F.col("title"), F.size("found"))).alias("title_terms"),
        F.array_distinct(F.flatten(F.collect_list("found"))).alias("every"),
    ))
    # a query has few words: one row each
    df = per.select(F.explode("every").alias("w")).groupBy("w").agg(F.count("*").alias("df")).limit(max(1, len(set(asked))))
    rare = df.join(F.broadcast(n)).select("w", F.when(F.col("w").isin(*T.GENERIC_WORDS), 0.0).otherwise(F.log1p(F.col("n") / (1 + F.col("df")))).alias("rare"))
    weights = per.select("course_id", F.explode("source").alias("w")).join(F.broadcast(rare), "w").groupBy("course_id").agg(F.round(F.sum("rare"), 9).alias("specificity"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    scored = per.join(weights, "course_id", "left").select("course_id", F.coalesce("specificity", F.lit(0.0)).alias("specificity"), F.size("source").alias("source_terms"), z("field_terms").alias("field_terms"), z("phrase").alias("phrase"), z("title_terms").alias("title_terms"), F.size("official").alias("official_terms"), F.size("facet").alias("facet_terms"))
    keys = ["specificity", "source_terms", "field_terms", "phrase", "title_terms", "official_terms", "facet_terms"]
    order = [*[F.desc(k) for k in keys], F.col("course_id")]
    if limit is None:
        return numbered(scored, order)
    return scored.orderBy(*order).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*order)))
