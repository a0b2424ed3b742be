import hashlib
import json
import lzma

import pytest

from tessergrid.sources import archives, assets, course_map, sinks


def _archive(folder, rows, parts=3):
    text = json.dumps({"courses": rows}).encode()
    packed = lzma.compress(text)
    step = -(-len(packed) // parts)
    made = []
    for i in range(parts):
        piece = packed[i * step : (i + 1) * step]
        (folder / f"catalog.xz.{i:03d}").write_bytes(piece)
        made.append({"name": f"catalog.xz.{i:03d}", "bytes": len(piece), "sha256": hashlib.sha256(piece).hexdigest()})
    return {"parts": made, "sha256": hashlib.sha256(packed).hexdigest(), "json_sha256": hashlib.sha256(text).hexdigest()}


def test_multipart_archive(spark, tmp_path):
    rows = [{"course_key": f"c{i}", "title": f"Tïtle {i}"} for i in range(5)]
    manifest = _archive(tmp_path, rows)
    got = archives.read_multipart_xz(spark, str(tmp_path), manifest, "courses", "course_key string, title string")
    assert sorted(r.title for r in got.collect()) == [r["title"] for r in rows]
    with pytest.raises(ValueError):
        archives.read_multipart_xz(spark, str(tmp_path), manifest | {"json_sha256": "0"}, "courses", "course_key string")
    (tmp_path / "catalog.xz.001").write_bytes(b"x" * manifest["parts"][1]["bytes"])
    with pytest.raises(ValueError):
        archives.read_multipart_xz(spark, str(tmp_path), manifest, "courses", "course_key string")


def test_payloads_pairs_and_datasets(spark, tmp_path):
    (tmp_path / "inv.json.xz").write_bytes(lzma.compress(json.dumps({"courses": [{"course_key": "k1", "title": "T"}]}).encode()))
    (tmp_path / "cls.json").write_text(json.dumps({"classifications": [{"course_key": "k1", "area": "x"}]}))
    pair = archives.load_pairs(spark, [(f"{tmp_path}/inv.json.xz", f"{tmp_path}/cls.json")], "course_key string, title string", "course_key string, area string")
    assert [(r.title, r.area) for r in pair.collect()] == [("T", "x")]
    wrong = spark.createDataFrame([("cls.json", "0", 1)], "file string, sha256 string, records bigint")
    with pytest.raises(ValueError):
        archives.read_payloads(spark, f"{tmp_path}/cls.json", "course_key string", wrong)


def test_jsonl_evidence_reports(spark, tmp_path):
    f = tmp_path / "c.jsonl"
    f.write_text("".join(json.dumps({"id": i, "v": "x"}) + "\n" for i in range(3)))
    sha = hashlib.sha256(f.read_bytes()).hexdigest()
    assert archives.read_jsonl(spark, str(f), "id int, v string", "id", 3, sha).count() == 3
    with pytest.raises(ValueError):
        archives.read_jsonl(spark, str(f), "id int, v string", "id", 4)
    rows = spark.createDataFrame([("a", "p", hashlib.sha256(b"p").hexdigest()), ("b", "p", "0")], "id string, payload string, fp string")
    assert archives.evidence(rows, "id", "a", "payload", "fp").count() == 1
    with pytest.raises(ValueError):
        archives.evidence(rows, "id", "b", "payload", "fp")
    (tmp_path / "evidence-1.json").write_text(json.dumps([{"evidence_id": "e1", "checked_on": "2024-01-01"}]))
    schema = "evidence_id string, checked_on string"
    assert archives.read_evidence(spark, str(tmp_path), schema).count() == 1
    (tmp_path / "evidence-2.json").write_text(json.dumps([{"evidence_id": "e1", "checked_on": "2024-01-01"}]))
    with pytest.raises(ValueError):
        archives.read_evidence(spark, str(tmp_path), schema)
    asked = spark.createDataFrame([("a",), ("b",)], "k string")
    got = archives.import_report(asked, spark.createDataFrame([("a", "done")], "k string, status string"), "k")
    assert {r.k: r.status for r in got.collect()} == {"a": "done", "b": "not-completed"}
    with pytest.raises(ValueError):
        archives.import_report(asked, spark.createDataFrame([("z", "done")], "k string, status string"), "k")
    (tmp_path / "t.json").write_text(json.dumps({"format": "taxonomy-1", "areas": ["x"]}))
    assert archives.read_tagged(spark, f"{tmp_path}/t.json", "areas array<string>", "taxonomy-1").first().areas == ["x"]
    with pytest.raises(ValueError):
        archives.read_tagged(spark, f"{tmp_path}/t.json", "areas array<string>", "brief-1")


def test_figures(spark):
    rows = spark.createDataFrame([(1, 1, "data:image/png;base64,aGk="), (1, 2, "https://x/y.png"), (1, 3, None), (1, 4, "data:image/png;base64,?")], "page int, n int, src string")
    got = {r.n: (r.bytes, r.gap) for r in assets.stage(rows, "page", "n", "src").collect()}
    assert got == {1: (2, None), 2: (None, "remote image"), 3: (None, "no source"), 4: (None, "undecodable image")}


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([(1, "=cmd", [1, 2])], "id int, t string, xs array<int>")
    b = spark.createDataFrame([(2, "plain", "new")], "id int, t string, extra string")
    sinks.write_csv(f"{tmp_path}/csv", a, b)
    back = spark.read.option("header", True).csv(f"{tmp_path}/csv")
    assert back.columns == ["id", "t", "xs", "extra"]
    assert {(r.id, r.t, r.xs) for r in back.collect()} == {("1", "'=cmd", "[1,2]"), ("2", "plain", None)}
    with pytest.raises(Exception):
        sinks.write_csv(f"{tmp_path}/csv", a)
    sinks.write_json(f"{tmp_path}/json", a)
    assert spark.read.json(f"{tmp_path}/json").count() == 1
    one = sinks.write_snapshot(b, f"{tmp_path}/snap", ["t"])
    assert one == sinks.write_snapshot(b.repartition(3), f"{tmp_path}/snap", ["t"])
    assert spark.read.parquet(f"{one}/facets").first().n == 1
    assert sinks.checked_copy(b, f"{tmp_path}/copy", "id", {}).count() == 1
    with pytest.raises(ValueError):
        sinks.checked_copy(b.union(b), f"{tmp_path}/copy2", "id", {})
    with pytest.raises(ValueError):
        sinks.checked_copy(b, f"{tmp_path}/copy3", "id", {"id": (a, "id")})
    assert sinks.explode_books(a, "xs").count() == 2
    sinks.export_public(b, ["id", "t"], f"{tmp_path}/public")
    leaky = spark.createDataFrame([("token = 'abcdefghijklmnop'",)], "t string")
    with pytest.raises(ValueError):
        sinks.export_public(leaky, ["t"], f"{tmp_path}/public2")


def _pair(spark, root, courses, labels):
    for name, kind, rows in (("inv", "courses", courses), ("cls", "classifications", labels)):
        course_map.put_dataset(spark, f"{root}/{name}", {"p.json": (kind, json.dumps({kind: rows}).encode(), len(rows))})


def test_course_map_is_strict(spark, tmp_path):
    _pair(spark, tmp_path, [{"course_key": "a"}], [{"course_key": "a", "primary_academic_area": "law"}])
    load = lambda **k: course_map.load_course_map(spark, str(tmp_path), [("inv", "cls")], **k)
    assert [r.course_key for r in load().collect()] == ["a"]
    with pytest.raises(ValueError):
        course_map.load_course_map(spark, str(tmp_path), [("inv", "none")])
    with pytest.raises(ValueError):
        course_map.load_course_map(spark, str(tmp_path), [("none", "none")], allow_partial=True)
    for wrong in ([("b", "x")], [("a", "x"), ("a", "y")]):
        with pytest.raises(ValueError):
            load(reviews=spark.createDataFrame(wrong, "course_key string, primary_academic_area string"))
    _pair(spark, tmp_path, [{"course_key": "a"}, {"course_key": "b"}], [{"course_key": "a"}])
    with pytest.raises(ValueError):
        load()


def test_materials_must_be_what_the_manifest_names(spark, tmp_path):
    course_map.put_dataset(spark, f"{tmp_path}/one", {"materials.json": ("materials", json.dumps({"materials": [{"course_key": "a"}]}).encode(), 1)})
    assert course_map.scan_materials(spark, str(tmp_path)).count() == 1
    assert course_map.scan_materials(spark, str(tmp_path), ("one",)).count() == 0
    course_map.put(spark, f"{tmp_path}/one/materials.json", json.dumps({"materials": [{"course_key": "b"}]}).encode())
    with pytest.raises(ValueError):
        course_map.scan_materials(spark, str(tmp_path))
    with pytest.raises(ValueError):
        course_map.one_collection(spark, f"{tmp_path}/one", "records", "course_key string")


def test_secrets_are_not_exported(spark, tmp_path):
    rows = spark.createDataFrame([(1, "fine"), (2, "password = 'abcdefghijklmnop'")], "id int, said string")
    with pytest.raises(ValueError):
        sinks.export_public(rows, ["id", "said"], f"{tmp_path}/out")
    sinks.export_public(rows, ["id"], f"{tmp_path}/ids")
    assert spark.read.parquet(f"{tmp_path}/ids").columns == ["id"]
