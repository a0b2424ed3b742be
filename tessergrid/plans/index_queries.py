"""Search in a stored index of the documents, bound to the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.text_index import TextIndex
from ..registry import query
from ..session import Tables, scratch
from .evidence_queries import QUERY_TERMS

_TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')"
_TERMS = ", ".join(f"'{t}'" for t in QUERY_TERMS)


def _bm25(docs: str, k: int) -> str:
    return f"""
WITH tok AS (SELECT doc_id, {_TOKENS} AS w FROM ({docs})), sizes AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM tok),
post AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, unnest(w) AS term, len(w) AS dl FROM tok) WHERE term IN ({_TERMS}) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
bm AS (SELECT doc_id, -sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS rank FROM post JOIN df USING (term), sizes GROUP BY doc_id)
SELECT doc_id, round(rank, 6) AS rank FROM bm ORDER BY round(bm.rank, 9), doc_id LIMIT {k}"""


def _index(t: Tables) -> TextIndex:
    return TextIndex(t.spark, f"{scratch(t.spark)}/index", unicode=False)


@query("T3 W6", _bm25("SELECT * FROM documents", 20))
def indexed_search(t: Tables) -> DataFrame:
    """BM25 over the stored index: only blocks that can hold one of the best are opened."""
    index = _index(t)
    index.add(t.documents, 0)
    return index.search(QUERY_TERMS, 20).select("doc_id", F.round("rank", 6).alias("rank"))


@query("T3 T4 T15 M1", _bm25("SELECT doc_id, CASE WHEN doc_id % 7 = 1 THEN text || ' than than erst' ELSE text END AS text FROM documents WHERE doc_id % 5 <> 3", 50))
def indexed_search_after_changes(t: Tables) -> DataFrame:
    """The same over an index that grew in two batches, had a seventh of its texts changed, and a fifth of them removed."""
    index = _index(t)
    index.add(t.documents.where("doc_id % 2 = 0"), 0)
    index.add(t.documents, 1)
    index.add(t.documents.where("doc_id % 7 = 1").withColumn("text", F.concat("text", F.lit(" than than erst"))), 2)
    index.remove(t.documents.where("doc_id % 5 = 3").select("doc_id"), 3)
    return index.search(QUERY_TERMS, 50).select("doc_id", F.round("rank", 6).alias("rank"))


@query("T4 A11", f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_TOKENS}) AS term FROM documents) WHERE term IN ({_TERMS}, 'no such term') GROUP BY term")
def index_frequencies(t: Tables) -> DataFrame:
    """How many documents have each term, from the heads of the stored blocks."""
    index = _index(t)
    index.add(t.documents, 0)
    return index.frequencies([*QUERY_TERMS, "no such term"])
