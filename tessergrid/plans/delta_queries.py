"""Counts kept current by signed changes, fingerprints as trees, and byte budgets, bound to the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.budgets import cut_to_budget
from ..operators.deltas import FacetCounts, signed_changes
from ..operators.hash_tree import differing_nodes, hash_tree
from ..registry import query
from ..session import Tables, scratch

def _orders_before(t: Tables) -> DataFrame:
    """The orders as they were: those of the first priority under another customer and status, those of 1998 not there yet, and others twice."""
    urgent = F.col("o_orderpriority") == "1-URGENT"
    held = t.orders.where("year(o_orderdate) < 1998")
    changed = held.withColumns({"o_custkey": F.when(urgent, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")), "o_orderstatus": F.when(urgent, F.lit("O")).otherwise(F.col("o_orderstatus"))})
    return changed.unionByName(held.where("o_totalprice > 300000"))


_FACETS = "(SELECT 'status' AS facet, o_orderstatus AS value, o_custkey FROM orders UNION ALL SELECT 'priority', o_orderpriority, o_custkey FROM orders UNION ALL SELECT 'month', strftime(o_orderdate, '%Y-%m'), o_custkey FROM orders)"


@query("M3 M5 A11", f'SELECT facet, value, count(*) AS "rows", count(DISTINCT o_custkey) AS members FROM {_FACETS} GROUP BY facet, value')
def facet_counts_after_changes(t: Tables) -> DataFrame:
    """Orders and customers of every status, priority and month, counted once and moved by what has changed since."""
    facets = {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"), "month": F.date_format("o_orderdate", "yyyy-MM")}
    kept = FacetCounts(t.spark, f"{scratch(t.spark)}/facets", facets, F.col("o_custkey"), buckets=16)
    before = _orders_before(t)
    kept.apply(before.withColumn("change", F.lit(1)), 0)
    kept.apply(signed_changes(before, t.orders), 1)
    return kept.counts(2)


@query("M1 M3", """
WITH old AS (SELECT * FROM documents UNION ALL SELECT doc_id, text, 'xx', source, n_chars FROM documents WHERE lang = 'de'),
signed AS (SELECT doc_id, lang, source, 1 AS change FROM documents UNION ALL SELECT doc_id, lang, source, -1 FROM old)
SELECT doc_id, lang, source, sum(change)::BIGINT AS change FROM signed GROUP BY ALL HAVING sum(change) <> 0""")
def signed_document_changes(t: Tables) -> DataFrame:
    """What leads from a snapshot in which German documents also stand under another name to the documents."""
    rows = t.documents.select("doc_id", "lang", "source")
    return signed_changes(rows.unionByName(rows.where("lang = 'de'").withColumn("lang", F.lit("xx"))), rows)


_BUDGET = 24_000
_FANOUT, _LEVELS = 64, 4


@query("W14", f"""
WITH RECURSIVE steps AS (SELECT doc_id, source, text, 0 AS step, length(text) AS len FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, source, text, step + 1, greatest(200, len // 2) FROM steps WHERE len > 200),
cuts AS (SELECT doc_id, source, len, strlen(left(text, len)) - strlen(left(text, greatest(200, len // 2))) AS saved FROM steps WHERE len > 200),
need AS (SELECT source, sum(strlen(text)) - {_BUDGET} AS need FROM documents GROUP BY source),
told AS (SELECT doc_id, source, coalesce(sum(saved) OVER (PARTITION BY source ORDER BY len DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM cuts),
made AS (SELECT doc_id, count(*) AS halvings FROM told JOIN need USING (source) WHERE before < need GROUP BY doc_id),
short AS (SELECT d.doc_id, d.source, coalesce(halvings, 0)::INTEGER AS halvings, coalesce(left(d.text, s.len), d.text) AS text FROM documents d LEFT JOIN made USING (doc_id) LEFT JOIN steps s ON s.doc_id = d.doc_id AND s.step = coalesce(halvings, 0)),
spent AS (SELECT *, sum(coalesce(strlen(text), 0)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS spent FROM short)
SELECT source, doc_id, text, halvings FROM spent WHERE spent <= {_BUDGET}""")
def texts_within_budget(t: Tables) -> DataFrame:
    """Of every source as much text as 24,000 bytes hold, the longest texts halved first."""
    return cut_to_budget(t.documents.select("source", "doc_id", "text"), "source", "doc_id", "text", _BUDGET)


_LEAVES = f"""
l0 AS (SELECT source, doc_id AS node, 1 AS n, sha256(coalesce('=' || text, 'null')) AS digest FROM {{}}),
""" + ",\n".join(f"l{k} AS (SELECT source, node // {_FANOUT} AS node, sum(n) AS n, sha256(string_agg(node || ':' || digest, chr(10) ORDER BY node)) AS digest FROM l{k - 1} GROUP BY source, node // {_FANOUT})" for k in range(1, _LEVELS + 1))
_TREE = " UNION ALL ".join(f"SELECT source, {k} AS level, node, n, digest FROM l{k}" for k in range(1, _LEVELS + 1))
_EDITED = "(SELECT doc_id, source, CASE WHEN n_chars > 5000 THEN text || '.' ELSE text END AS text FROM documents WHERE lang <> 'fr')"


@query("A21 K3", f'WITH {_LEAVES.format("documents")} SELECT source AS "group", level, node, n::BIGINT AS n, digest FROM ({_TREE})')
def fingerprint_tree(t: Tables) -> DataFrame:
    """Fingerprints of the texts of every source, by ranges of document ids, up to one a source."""
    return hash_tree(t.documents, "source", "doc_id", F.col("text"), _FANOUT, _LEVELS)


@query("A21 K3 M1", f"""
WITH new AS (WITH {_LEAVES.format("documents")} {_TREE}), old AS (WITH {_LEAVES.format(_EDITED)} {_TREE})
SELECT coalesce(o.source, n.source) AS "group", coalesce(o.level, n.level) AS level, coalesce(o.node, n.node) AS node, CASE WHEN o.digest IS NULL THEN 'added' WHEN n.digest IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM old o FULL JOIN new n ON o.source = n.source AND o.level = n.level AND o.node = n.node WHERE o.digest IS DISTINCT FROM n.digest""")
def changed_ranges(t: Tables) -> DataFrame:
    """Which ranges of the documents differ from a snapshot without the French ones, in which long texts end otherwise."""
    old = t.documents.where("lang <> 'fr'").withColumn("text", F.when(F.col("n_chars") > 5000, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    trees = [hash_tree(d, "source", "doc_id", F.col("text"), _FANOUT, _LEVELS) for d in (old, t.documents)]
    return differing_nodes(*trees)
