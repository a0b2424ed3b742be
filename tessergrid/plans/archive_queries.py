"""Sources and sinks as they are used: files are written to the shared folder, read back under their manifests, and compared."""

from __future__ import annotations

import base64
import hashlib
import json
import lzma

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..session import Tables, scratch
from ..sources import archives, assets, course_map, sinks, xz_parts
from .fixtures import Fixture


def _sha(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()


@query("S1", "SELECT n_nationkey, n_name FROM nation")
def archive_rows(t: Tables) -> DataFrame:
    """A table of bounded size as an archive in three parts, read back through all its checks."""
    folder = scratch(t.spark)
    rows = [r.asDict() for r in t.nation.select("n_nationkey", "n_name").collect()]
    text = json.dumps({"courses": rows}).encode()
    packed = lzma.compress(text)
    step = -(-len(packed) // 3)
    pieces = [packed[i : i + step] for i in range(0, len(packed), step)]
    for i, piece in enumerate(pieces):
        course_map.put(t.spark, f"{folder}/catalog.xz.{i:03d}", piece)
    manifest = {"parts": [{"name": f"catalog.xz.{i:03d}", "bytes": len(p), "sha256": _sha(p)} for i, p in enumerate(pieces)], "sha256": _sha(packed), "json_sha256": _sha(text)}
    return archives.read_multipart_xz(t.spark, folder, manifest, "courses", "n_nationkey int, n_name string")


@query("S1 S4", "SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-06-17'")
def archive_parts(t: Tables) -> DataFrame:
    """All lines as XZ parts by day of shipping, read back from a day on; parts of earlier days are not opened."""
    folder = f"{scratch(t.spark)}/lines"
    xz_parts.write_parts(t.lineitem, folder, by="l_shipdate")
    return xz_parts.read_parts(t.spark, folder).where(F.col("l_shipdate") >= F.lit("1995-06-17").cast("timestamp_ntz"))


@query("S1 S2", "SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers, min(o_orderkey) AS first_order, max(o_orderkey) AS last_order FROM orders GROUP BY o_orderpriority")
def archive_totals(t: Tables) -> DataFrame:
    """Totals over all parts of an archive of orders."""
    folder = f"{scratch(t.spark)}/orders"
    xz_parts.write_parts(t.orders, folder)
    rows = xz_parts.read_parts(t.spark, folder)
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"), F.min("o_orderkey").alias("first_order"), F.max("o_orderkey").alias("last_order"))


@query("S2 S3", "SELECT 'list.json' AS file, r_regionkey AS k, r_name AS v FROM region UNION ALL SELECT 'packed.json.xz', n_nationkey, n_name FROM nation")
def payload_rows(t: Tables) -> DataFrame:
    """A list, and an XZ object with several lists of which the first known one counts, under their hashes and counts."""
    folder = scratch(t.spark)
    regions = [{"k": r[0], "v": r[1]} for r in t.region.select("r_regionkey", "r_name").collect()]
    nations = [{"k": r[0], "v": r[1]} for r in t.nation.select("n_nationkey", "n_name").collect()]
    files = {"list.json": json.dumps(regions).encode(), "packed.json.xz": lzma.compress(json.dumps({"other": [1], "reviews": [], "sample": regions, "courses": nations}).encode())}
    for name, content in files.items():
        course_map.put(t.spark, f"{folder}/{name}", content)
    expected = t.spark.createDataFrame([("list.json", _sha(files["list.json"]), len(regions)), ("packed.json.xz", _sha(files["packed.json.xz"]), len(nations))], "file string, sha256 string, records bigint")
    return archives.read_payloads(t.spark, folder, "k int, v string", expected)


@query("S7 S14", "SELECT s_suppkey, s_name FROM supplier")
def jsonl_catalog(t: Tables) -> DataFrame:
    folder = f"{scratch(t.spark)}/suppliers"
    rows = t.supplier.select("s_suppkey", "s_name")
    sinks.write_json(folder, rows)
    return archives.read_jsonl(t.spark, folder, "s_suppkey bigint, s_name string", "s_suppkey", rows.count())


@query("S9", "SELECT 'evidence-' || (r_regionkey % 2) || '.json' AS file, 'e' || r_regionkey AS evidence_id, '2026-10-05' AS checked_on, r_name AS quote FROM region")
def evidence_files(t: Tables) -> DataFrame:
    folder = scratch(t.spark)
    rows = t.region.select("r_regionkey", "r_name").collect()
    for k in (0, 1):
        course_map.put(t.spark, f"{folder}/evidence-{k}.json", json.dumps({"records": [{"evidence_id": f"e{r[0]}", "checked_on": "2026-10-05", "quote": r[1]} for r in rows if r[0] % 2 == k]}).encode())
    course_map.put(t.spark, f"{folder}/other.json", b"not json")
    return archives.read_evidence(t.spark, folder, "evidence_id string, checked_on string, quote string")


def _json(rows: list[dict] | dict) -> bytes:
    return json.dumps(rows).encode()


def _materials(t: Tables) -> str:
    """Four folders: two with materials, one left out, one without a manifest."""
    root = scratch(t.spark)
    a = [
        {"course_key": "k1", "status": "Found", "materials": ["Signals", "Loads"], "catalog_statements": ["No exam"], "gaps": ["later terms"], "status_note": "later terms"},
        {"course_key": "k2", "status": "login needed", "institution": "MIT", "actual_materials_search_status": "ambiguous", "course_specific_material_search_status": "zzz", "source_url": "https://x.example"},
        {"course_key": None, "status": "found"}, {"course_key": "", "status": "found"},
    ]
    b = [{"course_key": "k1", "status": None, "materials": None, "status_note": "not yet"}, {"course_key": "k1", "status": "no material", "gaps": [""]}]
    course_map.put_dataset(t.spark, f"{root}/one", {"rows.json": ("materials", _json({"materials": a, "courses": []}), len(a)), "courses.json": ("courses", _json({"courses": b}), len(b))}, institution="Yale")
    course_map.put_dataset(t.spark, f"{root}/two", {"My-Materials.json.xz": (None, lzma.compress(_json({"courses": b})), len(b))}, institution="Brown")
    course_map.put_dataset(t.spark, f"{root}/made", {"materials.json": ("materials", _json({"materials": a}), len(a))}, institution="Penn")
    course_map.put(t.spark, f"{root}/loose/materials.json", _json({"materials": a}))
    return root


@query("S4", """
SELECT * FROM (VALUES
  ('k1', 'one/rows.json', 'Yale', 'found', []::VARCHAR[], 3, 1, NULL, ['later terms']), ('k2', 'one/rows.json', 'MIT', 'source-access-limited', ['ambiguous'], 0, 0, 'https://x.example', []),
  ('k1', 'two/My-Materials.json.xz', 'Brown', 'not-researched', [], 0, 0, NULL, ['not yet']), ('k1', 'two/My-Materials.json.xz', 'Brown', 'searched-no-public-material', [], 0, 0, NULL, [])) v(course_key, ledger_id, institution, status, more, n_materials, n_statements, source_url, gaps)""")
def source_rows(t: Tables) -> DataFrame:
    return course_map.scan_materials(t.spark, _materials(t), ("made",))


@query("S6", "SELECT 'k1' AS course_key, 'Found' AS status UNION ALL SELECT 'k2', 'login needed' UNION ALL SELECT NULL, 'found' UNION ALL SELECT '', 'found'")
def registered_readings(t: Tables) -> DataFrame:
    return course_map.one_collection(t.spark, _readings(t), "records", "course_key string, status string")


def _readings(t: Tables) -> str:
    folder = f"{scratch(t.spark)}/readings"
    rows = [{"course_key": "k1", "status": "Found"}, {"course_key": "k2", "status": "login needed"}, {"course_key": None, "status": "found"}, {"course_key": "", "status": "found"}]
    course_map.put_dataset(t.spark, folder, {"readings.json": ("records", _json({"records": rows}), len(rows)), "notes.json": ("notes", _json({"records": []}), 0)})
    return folder


_MAP = {
    "inv-a": [{"course_key": "c1", "institution": "MIT", "title": "Signals", "description": "On signals", "source_urls": ["u1", "u2"], "departments": ["EE"]}, {"course_key": "c2", "institution": "MIT", "title": "Loads"}],
    "inv-b": [
        {"course_key": "c1", "institution": "MIT 2", "title": "Signals II", "description": "Other words", "source_urls": ["u2", "u3"], "departments": None}, {"course_key": "c3", "title": "New", "description": "x"},
        {"course_key": "c2", "title": "Loads", "description": "Only here"},
    ],
    "inv-c": [{"course_key": "c1", "title": "S", "description": "On signals", "source_urls": []}, {"course_key": "c3", "title": "New", "description": "x"}],
    "cls-a": [{"course_key": "c1", "classification_status": "candidate", "review_reasons": [], "primary_academic_area": "eng", "areas": ["eng", "math"]}, {"course_key": "c2", "classification_status": "needs-review", "review_reasons": ["unmapped-area"], "primary_academic_area": "other", "areas": []}],
    "cls-b": [
        {"course_key": "c1", "classification_status": "needs-review", "review_reasons": ["parse", "a"], "primary_academic_area": "eng", "areas": ["math", "eng"]}, {"course_key": "c3", "classification_status": "candidate", "primary_academic_area": "law", "areas": ["law"]},
        {"course_key": "c2", "classification_status": "candidate", "primary_academic_area": "other", "areas": None},
    ],
    "cls-c": [{"course_key": "c1", "classification_status": "candidate", "primary_academic_area": "math", "areas": ["eng", "math"]}, {"course_key": "c3", "classification_status": "candidate", "primary_academic_area": "law", "areas": ["law", "art"]}],
}


@query("S5 A3 F16", """
SELECT * FROM (VALUES
  ('c1', 'MIT', 'Signals', ['u1', 'u2', 'u3'], ['EE'], 'eng', 'needs-review', ['a', 'conflicting-source-classifications', 'parse', 'source-classification-needs-review'], ['inv-b: Other words'], ['inv-c: math'], ['inv-a', 'inv-b', 'inv-c']),
  ('c2', 'MIT', 'Loads', []::VARCHAR[], []::VARCHAR[], 'other', 'needs-review', ['unmapped-area'], ['inv-b: Only here'], [], ['inv-a', 'inv-b']),
  ('c3', NULL, 'New', [], [], 'history', 'reviewed', ['conflicting-source-classifications'], [], ['inv-c: law'], ['inv-b', 'inv-c'])) v(course_key, institution, title, source_urls, departments, primary_academic_area, classification_status, review_reasons, descriptions, classifications, inventories)""")
def course_map_load(t: Tables) -> DataFrame:
    """Three pairs of folders and one that is missing, as one map, with a review over it."""
    root = scratch(t.spark)
    for name, rows in _MAP.items():
        kind = "courses" if name.startswith("inv") else "classifications"
        course_map.put_dataset(t.spark, f"{root}/{name}", {"part.json": (kind, _json({kind: rows}), len(rows))})
    reviews = t.spark.createDataFrame([("c3", "history")], "course_key string, primary_academic_area string")
    pairs = [(f"inv-{x}", f"cls-{x}") for x in "azbc"]
    made = course_map.load_course_map(t.spark, root, pairs, allow_partial=True, reviews=reviews).drop("description")
    spell = lambda c, f: F.transform(c, lambda x: F.concat_ws(": ", x["inventory"], x[f]))
    return made.withColumns({"descriptions": spell("description_variants", "description"), "classifications": spell("classification_variants", "primary_academic_area")}).drop("description_variants", "classification_variants")


_PIXEL = base64.b64encode(b"pixel").decode()
_FIGURES = Fixture(
    "figures",
    "page int, n int, src string",
    (
        (1, 1, f"data:image/png;base64,{_PIXEL}"), (1, 2, "https://x.example/a.png"), (1, 3, "img/a.png"), (1, 4, None), (1, 5, ""), (1, 6, "data:image/png;base64,%%%"), (1, 7, "data:image/svg+xml,<svg/>"), (1, 8, "//cdn.example/b.png"), (1, 9, f"data:image/png;base64,{_PIXEL}"), (1, 10, f"data:image/png;base64,{_PIXEL}"),
        (2, 1, "data:image/png;base64," + base64.b64encode(b"x" * 30).decode()), (2, 2, f"data:image/png;base64,{_PIXEL}"), (2, 3, "data:text/plain,hello"),
    ),
)


@query("S12", f"""
SELECT page, n, CASE WHEN k > 0 THEN sha256(repeat(c, k)) END AS sha256, gap FROM (VALUES
  (1, 1, 'pixel', 1, NULL), (1, 2, '', 0, 'remote image'), (1, 3, '', 0, 'local file not supplied'), (1, 4, '', 0, 'no source'), (1, 5, '', 0, 'no source'), (1, 6, '', 0, 'undecodable image'), (1, 7, '<svg/>', 1, NULL), (1, 8, '', 0, 'remote image'),
  (1, 9, 'pixel', 1, NULL), (1, 10, '', 0, 'too many images'), (2, 1, 'x', 30, NULL), (2, 2, '', 0, 'images too large together'), (2, 3, '', 0, 'local file not supplied')) v(page, n, c, k, gap)""")
def staged_figures(t: Tables) -> DataFrame:
    return assets.stage(_FIGURES.frame(t.spark), "page", "n", "src", most_files=3, most_bytes=32).select("page", "n", "sha256", "gap")


_CELLS = Fixture("cells", "id int, said string, tags array<string>", ((1, "=1+1", ["a", "b"]), (2, " @x", None), (3, 'quote "and", comma', []), (4, None, ["-x"]), (5, "plain", ["é"]), (6, "+", None), (7, "-", None), (8, "line\nbreak", None)))


@query("K1 K2 K6", """
SELECT id::VARCHAR AS id, said, tags, more FROM (VALUES (1, '''=1+1', '["a","b"]', NULL), (2, ''' @x', NULL, NULL), (3, 'quote "and", comma', '[]', NULL), (4, NULL, '["-x"]', NULL), (5, 'plain', '["é"]', NULL), (6, '''+', NULL, NULL), (7, '''-', NULL, NULL), (8, 'line' || chr(10) || 'break', NULL, NULL),
  (9, NULL, NULL, '{"a":1}')) v(id, said, tags, more)""")
def csv_export(t: Tables) -> DataFrame:
    """Two collections under the union of their columns, as a spreadsheet may read them."""
    path = f"{scratch(t.spark)}/rows"
    other = t.spark.createDataFrame([(9,)], "id int").withColumn("more", F.struct(F.lit(1).alias("a")))
    sinks.write_csv(path, _CELLS.frame(t.spark), other)
    return t.spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


@query("K3 K4", "SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def snapshot_manifest(t: Tables) -> DataFrame:
    """Rows stored under a name made of their content; writing them once more in another order changes nothing."""
    rows, folder = t.documents.select("doc_id", "lang", "source"), scratch(t.spark)
    path = sinks.write_snapshot(rows, folder, ["lang", "source"])
    if sinks.write_snapshot(rows.repartition(3), folder, ["lang", "source"]) != path:
        raise ValueError("the same rows have two names")
    return t.spark.read.parquet(f"{path}/facets")


@query("K7 M6", "SELECT o_orderkey, o_custkey FROM orders")
def backup_check(t: Tables) -> DataFrame:
    return sinks.checked_copy(t.orders.select("o_orderkey", "o_custkey"), f"{scratch(t.spark)}/copy", "o_orderkey", {"o_custkey": (t.customer, "c_custkey")})


@query("K8 K10", "SELECT '{\"id\":' || event_id || ',\"state\":\"' || event_type || '\"}' AS line FROM events")
def job_export(t: Tables) -> DataFrame:
    path = f"{scratch(t.spark)}/rows"
    sinks.write_json(path, t.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("state")))
    return t.spark.read.text(path).select(F.col("value").alias("line"))


@query("K12", "SELECT s_suppkey, s_name FROM supplier")
def public_export(t: Tables) -> DataFrame:
    path = f"{scratch(t.spark)}/rows"
    sinks.export_public(t.supplier, ["s_suppkey", "s_name"], path)
    return t.spark.read.parquet(path)


_REPORT = Fixture("report", "isbn string, status string", (("a", "done"), ("b", None), ("d", "failed")))
_ASKED = Fixture("asked", "isbn string, book string", (("a", "Signals"), ("b", "Loads"), ("c", "Scales"), ("d", "Beams")))


@query("S16", f"WITH {_REPORT.sql}, {_ASKED.sql} SELECT a.isbn, book, coalesce(status, 'not-completed') AS status FROM asked a LEFT JOIN report r ON r.isbn = a.isbn")
def report_import(t: Tables) -> DataFrame:
    return archives.import_report(_ASKED.frame(t.spark), _REPORT.frame(t.spark), "isbn")
