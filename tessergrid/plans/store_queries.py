"""Loading, exporting and storing evidence, bound to the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..session import Tables
from ..sources import archives, sinks


@query("S8", "SELECT doc_id, source, sha256(text) AS fingerprint FROM documents WHERE doc_id = 17")
def evidence_lookup(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "source", "text", F.sha2("text", 256).alias("fingerprint"))
    return archives.evidence(rows, "doc_id", 17, "text", "fingerprint").drop("text")


@query("S15", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3")
def owned_rows(t: Tables) -> DataFrame:
    """Ownership is a literal on a partition column, so other owners' files are not read."""
    return t.customer.where(F.col("c_nationkey") == 3).select("c_custkey", "c_name")


@query("K5 K2 K6", "SELECT c_custkey, o.o_orderkey AS book FROM customer LEFT JOIN orders o ON c_custkey = o_custkey AND o_totalprice > 200000")
def explode_books(t: Tables) -> DataFrame:
    books = t.orders.where("o_totalprice > 200000").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("books"))
    rows = t.customer.select("c_custkey").join(books, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey")
    return sinks.explode_books(rows, "books")


@query("M10", """
WITH h AS (SELECT conv_id, turn, 1 + (turn * 7 + conv_id) % 4 AS level FROM conversations), p AS (SELECT a.conv_id, a.turn, max(b.turn) AS parent FROM h a LEFT JOIN h b ON a.conv_id = b.conv_id AND b.turn < a.turn AND b.level < a.level GROUP BY ALL)
SELECT conv_id, count(*) AS nodes, count(*) FILTER (WHERE parent IS NULL) AS roots, true AS sound FROM p GROUP BY conv_id""")
def tree_validation(t: Tables) -> DataFrame:
    """A document tree is sound if every parent is a node of it that comes before."""
    from ..operators.trees import parents

    headings = t.conversations.select("conv_id", "turn", (1 + (F.col("turn") * 7 + F.col("conv_id")) % 4).alias("level"))
    nodes = parents(headings, "conv_id", "turn", "level").select("conv_id", "turn", "parent")
    known = nodes.select("conv_id", F.col("turn").alias("parent"), F.lit(True).alias("there"))
    judged = nodes.join(known, ["conv_id", "parent"], "left")
    sound = F.bool_and(F.col("parent").isNull() | (F.coalesce("there", F.lit(False)) & (F.col("parent") < F.col("turn"))))
    return judged.groupBy("conv_id").agg(F.count("*").alias("nodes"), F.count_if(F.col("parent").isNull()).alias("roots"), sound.alias("sound"))
