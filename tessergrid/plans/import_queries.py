"""Importing scopes and claims, and the star they are stored in, on awkward rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import incremental as N
from ..registry import query
from ..session import Tables
from .fixtures import Fixture

_SCOPES = Fixture("scopes", "scope string, fingerprint string", (("s", "f1"), ("t", "f9")))
_MEMBERS = Fixture("members", "scope string, node string", (("s", "a"), ("s", "b"), ("s", "c"), ("s", "d"), ("s", "e"), ("s", "f"), ("s", "a"), ("t", "b"), ("t", "x")))
_LINKS = Fixture("links", "scope string, edge string", (("s", "ab"), ("s", "cd"), ("s", "ex"), ("s", "ax"), ("t", "cd"), ("s", "fx")))
_EDGES = Fixture("edges", "edge string, src string, dst string, status string", (("ab", "a", "b", "candidate"), ("cd", "c", "y", "candidate"), ("ex", "e", "x", "reviewed"), ("ax", "a", "x", "candidate"), ("fx", "x", "f", "candidate"), ("zz", "z", "z", "candidate")))
_NODES = {"reviewed": ("d",), "fixed": ("f",), "current": ("a", "new")}


def _import(t: Tables, fingerprint: str) -> tuple[DataFrame, DataFrame]:
    one = {k: t.spark.createDataFrame([(n,) for n in v], "node string") for k, v in _NODES.items()}
    now = t.spark.createDataFrame([("ax",)], "edge string")
    return N.import_scope(*[x.frame(t.spark) for x in (_SCOPES, _MEMBERS, _LINKS, _EDGES)], one["reviewed"], one["fixed"], "s", fingerprint, one["current"], now)


@query("M3", """
SELECT * FROM (VALUES ('b', 'keep'), ('c', 'deactivate'), ('d', 'deactivate'), ('e', 'deactivate'), ('f', 'keep')) v(node, action)""")
def scope_import(t: Tables) -> DataFrame:
    return _import(t, "f2")[0]


@query("M3", "SELECT * FROM (VALUES ('ab', 'delete'), ('ex', 'keep'), ('fx', 'delete')) v(edge, action)")
def scope_edges(t: Tables) -> DataFrame:
    return _import(t, "f2")[1]


@query("M3", "SELECT 0 AS changes")
def scope_unchanged(t: Tables) -> DataFrame:
    return _import(t, "f1")[0].agg(F.count("*").cast("int").alias("changes"))


_CLAIMS = Fixture(
    "claims",
    "claim string, region_id string, region_fingerprint string, kind string, title string, content string, claim_type string, quote string, visual boolean",
    (
        ("c1", "r1", "f1", "fact", "Drift", "x", None, "Sensors drift", None), ("c2", "r1", "f0", "fact", "Drift", "x", None, "Sensors drift", None), ("c3", "r9", "f1", "fact", "T", "x", None, "q", None), ("c4", "r2", "f2", "fact", "T", "x", None, "page", None), ("c5", "r2", "f2", "fact", "T", "x", "source-claim", "page", True),
        ("c6", "r1", "f1", "fact", " ", "x", None, "Sensors", None), ("c7", "r1", "f1", "fact", "T", "x", "synthesis", "Sensors", None), ("c8", "r1", "f1", "fact", "T", "x", None, None, None), ("c9", "r1", "f1", "fact", "T", "x", None, "sensors drift", None),
    ),
)
_REGIONS = Fixture("regions", "region_id string, fingerprint string, text string, needs_visual boolean", (("r1", "f1", "Sensors drift.", False), ("r2", "f2", "A page", True)))
_EARLIER = Fixture("earlier", "claim string, region_id string, title string", (("o1", "r1", "Drift"), ("o2", "r1", "T"), ("o3", "r2", "T"), ("o4", "r9", "T")))


def _claims(t: Tables) -> tuple[DataFrame, DataFrame]:
    return N.import_claims(*[x.frame(t.spark) for x in (_CLAIMS, _REGIONS, _EARLIER)])


@query("M9", "SELECT * FROM (VALUES ('c1', NULL), ('c2', 'stale region'), ('c3', 'unknown region'), ('c4', 'page not inspected'), ('c5', NULL), ('c6', 'incomplete'), ('c7', 'not a source claim'), ('c8', 'no anchor'), ('c9', 'quote not in region')) v(claim, fault)")
def anchored_import(t: Tables) -> DataFrame:
    return _claims(t)[0]


@query("M9", "SELECT * FROM (VALUES ('o1', 'superseded'), ('o2', 'current'), ('o3', 'superseded'), ('o4', 'current')) v(claim, status)")
def superseded_knowledge(t: Tables) -> DataFrame:
    return _claims(t)[1]


_KNOWLEDGE = Fixture("knowledge", "id string, state string, regions array<string>", (("k1", "reviewed", ["r1", "r2"]), ("k2", "draft", ["r3"]), ("k3", "reviewed", ["r2", "zz"]), ("k4", "reviewed", [])))


@query("K9", "SELECT * FROM (VALUES ('r1', 1::BIGINT), ('r2', 2)) v(region_id, cited)")
def cited_regions(t: Tables) -> DataFrame:
    """Regions that reviewed knowledge cites; what it cites must be there to be packaged."""
    cited = _KNOWLEDGE.frame(t.spark).where("state = 'reviewed'").select(F.explode(F.array_distinct("regions")).alias("region_id")).groupBy("region_id").agg(F.count("*").alias("cited"))
    return cited.join(_REGIONS.frame(t.spark).select("region_id"), "region_id", "left_semi")


_FLAT = Fixture("flat", "course_key string, institution string, school string, title string, at int", (("a", "MIT", "", "Old", 1), ("a", "mit ", "Sloan", "New", 2), ("b", "MIT", "SLOAN", "B", 1), ("c", "Yale", "Sloan", "C", 1), ("d", "Yale", None, "D", 1)))


@query("M5", """
SELECT * FROM (VALUES ('institutions', 2), ('schools', 2), ('courses', 4), ('courses without a school', 1), ('courses of the first school', 2)) v(part, n)""")
def star_projection(t: Tables) -> DataFrame:
    institutions, schools, courses = N.star(_FLAT.frame(t.spark))
    first = schools.where("name in ('Sloan', 'SLOAN')").join(institutions.where("lower(name) = 'mit'").select(F.col("id").alias("institution_id")), "institution_id").select(F.col("id").alias("school_id"))
    parts = {"institutions": institutions, "schools": schools, "courses": courses, "courses without a school": courses.where("school_id is null"), "courses of the first school": courses.join(first, "school_id", "left_semi")}
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").cast("int").alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out
