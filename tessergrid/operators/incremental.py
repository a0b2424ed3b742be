"""Keeping derived tables current: snapshots, scopes, histories, cascades."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stored

#: Levels of a closure that are read one by one before they are written as one.
_MERGE = 16


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """(key, change): insert, update, same or delete, by fingerprint."""
    a, b = old.select(key, F.col(fingerprint).alias("was")), new.select(key, F.col(fingerprint).alias("now"))
    change = F.when(F.col("was").isNull(), "insert").when(F.col("now").isNull(), "delete").when(F.col("was") == F.col("now"), "same").otherwise("update")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The new rows, and the old ones that no new row replaces."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def finish_scope(members: DataFrame, scope: str, current: DataFrame, node: str) -> DataFrame:
    """(node, action) for what a scope no longer has: keep if another scope has it, else delete."""
    mine = members.where(F.col("scope") == scope).select(node)
    stale = mine.join(current.select(node), node, "left_anti").distinct()
    others = members.where(F.col("scope") != scope).select(node).distinct().withColumn("elsewhere", F.lit(True))
    return stale.join(others, node, "left").select(node, F.when(F.col("elsewhere"), "keep").otherwise("delete").alias("action"))


def history(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """version (from 1) and state: the last version of a key is current, earlier ones stale."""
    w = Window.partitionBy(key).orderBy(*order)
    n = F.count("*").over(Window.partitionBy(key))
    return df.withColumn("version", F.row_number().over(w)).withColumn("state", F.when(F.col("version") == n, "current").otherwise("stale"))


def closure(edges: DataFrame, roots: DataFrame, parent: str = "parent", child: str = "child") -> DataFrame:
    """(node, depth): everything under the roots, however deep, by one join a level; a node counts where it is first reached.

    A level is written once and appended; every ``_MERGE`` levels become one, so that plans stay short.
    """
    front = stored(roots.select(F.col(roots.columns[0]).alias("node")).distinct().withColumn("depth", F.lit(0)))
    levels = [front]
    for depth in count(1):  # nodes that were seen do not come again, so cycles end
        seen = reduce(DataFrame.unionByName, levels)
        if len(levels) > _MERGE:
            seen = stored(seen)
            levels = [seen]
        reached = front.join(edges, front["node"] == edges[parent]).select(F.col(child).alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        front = stored(reached.withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return seen
        levels.append(front)


def cascade(children: DataFrame, deleted: DataFrame, *references: tuple[str, str]) -> DataFrame:
    """Children none of whose references point at a deleted row."""
    for own, key in references:
        children = children.join(deleted.select(F.col(key).alias(own)), own, "left_anti")
    return children


def pending(rows: DataFrame, done: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Rows whose current fingerprint has not been processed."""
    return rows.join(done.select(key, fingerprint), [key, fingerprint], "left_anti")


def import_scope(scopes: DataFrame, members: DataFrame, links: DataFrame, edges: DataFrame, reviewed: DataFrame, fixed: DataFrame, scope: str, fingerprint: str, current: DataFrame, current_links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What importing a scope anew does to nodes and edges: (node, action) and (edge, action); nothing if it is as it was.

    ``scopes`` is (scope, fingerprint), ``members`` (scope, node), ``links`` (scope, edge), ``edges`` (edge, src, dst, status),
    ``reviewed`` and ``fixed`` nodes; ``current`` and ``current_links`` are what the scope has now. An edge that no scope has any
    more goes unless it was reviewed. A node that the scope has no more stays if another scope has it, is deactivated if an edge
    that is left or a review names it, stays if it is fixed, and goes otherwise.
    """
    same = scopes.where((F.col("scope") == scope) & (F.col("fingerprint") == fingerprint)).limit(1).count() == 1
    mine, others = members.where(F.col("scope") == scope).select("node"), members.where(F.col("scope") != scope).select("node").distinct()
    own = links.where(F.col("scope") == scope).select("edge")
    held = links.where(F.col("scope") != scope).select("edge").unionByName(current_links.select("edge")).distinct()
    gone = own.join(held, "edge", "left_anti").distinct()
    told = gone.join(edges, "edge").select("edge", F.when(F.col("status") == "reviewed", "keep").otherwise("delete").alias("action"))
    left = edges.join(told.where("action = 'delete'"), "edge", "left_anti")
    named = left.select(F.explode(F.array("src", "dst")).alias("node")).unionByName(reviewed.select("node")).distinct()
    mark = lambda df, name: df.select("node").distinct().withColumn(name, F.lit(True))
    stale = mine.join(current.select("node"), "node", "left_anti").distinct()
    seen = stale.join(mark(others, "elsewhere"), "node", "left").join(mark(named, "named"), "node", "left").join(mark(fixed, "fixed"), "node", "left")
    action = F.when(F.col("elsewhere"), "keep").when(F.col("named"), "deactivate").when(F.col("fixed"), "keep").otherwise("delete")
    nodes = seen.select("node", action.alias("action"))
    return (nodes.limit(0), told.limit(0)) if same else (nodes, told)


def import_claims(claims: DataFrame, regions: DataFrame, earlier: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Knowledge read from a region: (claim, fault), null for what is taken, and the (claim, status) of what was there before.

    ``claims`` is (claim, region_id, region_fingerprint, kind, title, content, claim_type, quote, visual), ``regions`` (region_id,
    fingerprint, text, needs_visual), ``earlier`` (claim, region_id, title). A claim says what it is, quotes its region as it is
    now, and has been seen where the page must be. What a taken claim of the same region and title replaces is superseded.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    both = claims.join(regions.withColumnRenamed("fingerprint", "now"), "region_id", "left")
    fault = (
        F.when(F.col("now").isNull(), "unknown region")
        .when(F.col("now") != F.col("region_fingerprint"), "stale region")
        .when(F.col("needs_visual") & ~F.coalesce("visual", F.lit(False)), "page not inspected")
        .when(blank("title") | blank("kind") | blank("content"), "incomplete")
        .when(F.coalesce("claim_type", F.lit("source-claim")) != "source-claim", "not a source claim")
        .when(blank("quote"), "no anchor")
        .when(~F.contains("text", "quote"), "quote not in region")
    )
    judged = both.select("claim", "region_id", "title", fault.alias("fault"))
    taken = judged.where("fault is null").select("region_id", "title").distinct().withColumn("again", F.lit(True))
    status = F.when(F.col("again"), "superseded").otherwise("current")
    return judged.select("claim", "fault"), earlier.join(taken, ["region_id", "title"], "left").select("claim", status.alias("status"))


def star(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Institutions (id, name), schools (id, institution_id, name) and courses (course_key, institution_id, school_id, title) of flat rows.

    Ids are of names, so the same name is one row whoever writes it; a course without a school has none. The last row of a
    course counts, by ``at``.
    """
    iid = F.substring(F.sha2(F.lower(F.trim("institution")), 256), 1, 24)
    sid = F.when(F.coalesce(F.trim("school"), F.lit("")) != "", F.substring(F.sha2(F.concat_ws("|", F.lower(F.trim("institution")), F.lower(F.trim("school"))), 256), 1, 24))
    named = rows.withColumns({"institution_id": iid, "school_id": sid})
    institutions = named.groupBy(F.col("institution_id").alias("id")).agg(F.min(F.trim("institution")).alias("name"))
    schools = named.where("school_id is not null").groupBy(F.col("school_id").alias("id"), "institution_id").agg(F.min(F.trim("school")).alias("name"))
    last = named.groupBy("course_key").agg(F.max_by(F.struct("institution_id", "school_id", "title"), "at").alias("c"))
    return institutions, schools, last.select("course_key", "c.*")
