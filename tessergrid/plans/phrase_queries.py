"""Phrases of parts and of benchmark items in the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import phrase_search as P
from ..registry import query
from ..session import Tables

_WORDS = "regexp_extract_all(lower(text), '[\\pL\\pN_]+')"
_PHRASES = f"""
said AS (SELECT doc_id, unnest(range(0, len(w))) AS place, unnest(w) AS a, unnest(w[2:] || [NULL]) AS b FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE len(w) > 0),
phrases AS (SELECT unnest(string_split(p_name, ' ')) AS phrase FROM part UNION SELECT w[i] || ' ' || w[i + 1] FROM (SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT {_WORDS} AS w FROM benchmark))),
places AS (SELECT doc_id, place, phrase FROM said JOIN phrases ON phrase = a UNION ALL SELECT doc_id, place, phrase FROM said JOIN phrases ON phrase = a || ' ' || b)"""


def _phrases(t: Tables) -> DataFrame:
    words = t.part.select(F.explode(F.split("p_name", " ")).alias("phrase"))
    said = t.benchmark.select(T.tokens(F.col("text")).alias("w"))
    pairs = said.where(F.size("w") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.array_join(F.slice("w", i, 2), " "))).alias("phrase"))
    return words.union(pairs)


@query("R1 R11 R15 T6", f"WITH {_PHRASES} SELECT phrase, count(DISTINCT doc_id) AS n_texts, count(*) AS n_places FROM places GROUP BY phrase")
def phrase_frequencies(t: Tables) -> DataFrame:
    """How many documents have each word of a part's name and each two-word run of a benchmark item, and how often."""
    return P.phrase_counts(t.documents, "doc_id", T.tokens(F.col("text")), _phrases(t))


@query("R1 T6", f"WITH {_PHRASES} SELECT doc_id, count(*) AS n_places, count(DISTINCT phrase) AS n_phrases, min(place)::BIGINT AS first_place, arg_min(phrase, (place, phrase)) AS first_phrase FROM places GROUP BY doc_id")
def phrase_first_places(t: Tables) -> DataFrame:
    """Where the first phrase of each document stands; of several there the least."""
    places = P.phrase_places(t.documents, "doc_id", T.tokens(F.col("text")), _phrases(t))
    first = F.min(F.struct("place", "phrase"))
    return places.groupBy("doc_id").agg(F.count("*").alias("n_places"), F.countDistinct("phrase").alias("n_phrases"), first["place"].alias("first_place"), first["phrase"].alias("first_phrase"))
