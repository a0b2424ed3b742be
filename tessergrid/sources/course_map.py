"""Datasets of courses and materials that name their files in manifests, and one record a course out of several datasets."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import assert_empty
from ..operators.joins import mismatches
from ..operators.ledger import research_status
from .archives import read_payloads, unpacked

_FILES = "array<struct<file:string,collection:string,sha256:string,compressed_sha256:string,records:bigint>>"
_MATERIALS = "course_key string, institution string, status string, course_specific_material_search_status string, actual_materials_search_status string, source_url string, materials array<string>, catalog_statements array<string>, gaps array<string>, status_note string"
_COURSES = "course_key string, institution string, title string, description string, source_urls array<string>, departments array<string>"
_LABELS = "course_key string, classification_status string, review_reasons array<string>, primary_academic_area string, areas array<string>"


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """(folder, institution, file, collection, sha256, records): the files that the manifests under a root name; other folders do not count."""
    found = spark.read.schema(f"institution string, files {_FILES}").option("multiLine", True).json(f"{root}/*/manifest.json")
    rows = found.select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("folder"), "institution", F.explode("files").alias("f"))
    return rows.select("folder", "institution", "f.file", "f.collection", F.coalesce("f.compressed_sha256", "f.sha256").alias("sha256"), "f.records")


def one_collection(spark: SparkSession, folder: str, collection: str, schema: str) -> DataFrame:
    """Rows of the only file that a folder's manifest registers for a collection; none or several raise."""
    root, name = folder.rsplit("/", 1)
    named = manifests(spark, root).where((F.col("folder") == name) & (F.col("collection") == collection)).limit(2).collect()
    if len(named) != 1:
        raise ValueError(f"{name} registers {len(named) or 'no'} files of {collection}")
    expected = spark.createDataFrame([(named[0]["file"], named[0]["sha256"], named[0]["records"])], "file string, sha256 string, records bigint")
    return read_payloads(spark, f"{folder}/{named[0]['file']}", schema, expected).drop("file")


def scan_materials(spark: SparkSession, root: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """(course_key, ledger_id, institution, status, more, n_materials, n_statements, source_url, gaps) of every materials file under a root.

    A file counts if a manifest says that it holds materials or its name does; its hash must be the manifest's. Rows without
    a course are none. Statements of a catalogue are materials of their own; ``more`` are further statuses that say something.
    """
    named = manifests(spark, root).where(~F.col("folder").isin(list(excluded)) & ((F.col("collection") == "materials") | F.lower("file").contains("material")))
    # a catalogue has few files; what they hold is read by Spark
    files = named.collect()
    if not files:
        return spark.createDataFrame([], "course_key string, ledger_id string, institution string, status string, more array<string>, n_materials int, n_statements int, source_url string, gaps array<string>")
    rows = unpacked(spark, [f"{root}/{f['folder']}/{f['file']}" for f in files], ("materials", "courses"))
    told = rows.join(F.broadcast(named.withColumnRenamed("sha256", "promised").withColumnRenamed("folder", "dataset").select("dataset", "file", "promised", F.col("institution").alias("of"))), ["dataset", "file"])
    assert_empty(told.where("promised is not null and promised <> sha256").select("dataset", "file").distinct(), "materials files that have changed")
    r = told.select("dataset", "file", "of", F.from_json("value", _MATERIALS).alias("r")).select("dataset", "file", "of", "r.*").where(F.coalesce("course_key", F.lit("")) != "")
    none = F.array().cast("array<string>")
    further = F.transform(F.array("course_specific_material_search_status", "actual_materials_search_status"), research_status)
    gaps = F.array_distinct(F.filter(F.concat(F.coalesce("gaps", none), F.array("status_note")), lambda g: F.coalesce(g, F.lit("")) != ""))
    count = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0))
    return r.select(
        "course_key", F.concat_ws("/", "dataset", "file").alias("ledger_id"), F.coalesce("institution", "of").alias("institution"), research_status(F.col("status")).alias("status"),
        F.array_sort(F.array_distinct(F.filter(further, lambda s: s != "not-researched"))).alias("more"), (count("materials") + count("catalog_statements")).alias("n_materials"), count("catalog_statements").alias("n_statements"), "source_url", gaps.alias("gaps"),
    )


def load_course_map(spark: SparkSession, root: str, pairs: list[tuple[str, str]], *, allow_partial: bool = False, reviews: DataFrame | None = None) -> DataFrame:
    """One record a course out of pairs of folders (inventory, classification), in their order.

    Both folders name the same files, whose courses are classified one to one. A missing folder raises unless a partial map
    is asked for. ``reviews`` is (course_key, primary_academic_area): of known courses, one each.
    """
    every = manifests(spark, root)
    named: dict[str, dict[str, str]] = {}
    for f in every.select("folder", "file", "collection").where("collection is null or collection in ('courses', 'classifications')").collect():
        named.setdefault(f["folder"], {})[f["file"]] = f["collection"]
    out = None
    for order, (inventory, labels) in enumerate(pairs):
        if inventory not in named or labels not in named:
            if allow_partial:
                continue
            raise ValueError(f"missing dataset: {inventory} with {labels}")
        if set(named[inventory]) != set(named[labels]):
            raise ValueError(f"the files of {labels} are not those of {inventory}")
        for file in sorted(named[inventory]):
            a, b = read_payloads(spark, f"{root}/{inventory}/{file}", _COURSES).drop("file"), read_payloads(spark, f"{root}/{labels}/{file}", _LABELS).drop("file")
            assert_empty(mismatches(a, b, "course_key"), f"courses of {inventory} and {labels}")
            pair = a.join(b, "course_key").withColumns({"dataset_order": F.lit(order), "inventory": F.lit(inventory)})
            out = pair if out is None else out.unionByName(pair)
    if out is None:
        raise ValueError("no dataset is there")
    merged = merge_courses(out)
    if reviews is not None:
        assert_empty(reviews.groupBy("course_key").count().where("count > 1"), "courses reviewed twice")
        assert_empty(reviews.join(merged, "course_key", "left_anti"), "reviews of unknown courses")
        told = reviews.select("course_key", F.col("primary_academic_area").alias("reviewed"))
        merged = merged.join(told, "course_key", "left").withColumns({"primary_academic_area": F.coalesce("reviewed", "primary_academic_area"), "classification_status": F.when(F.col("reviewed").isNotNull(), "reviewed").otherwise(F.col("classification_status"))}).drop("reviewed")
    return merged


def merge_courses(rows: DataFrame) -> DataFrame:
    """One record a course: the first dataset's fields, lists united in the order of datasets, and what others say differently.

    A course needs review if any dataset says so, or if datasets classify it differently. Datasets are few, so a course
    gathers few rows.
    """
    none = F.array().cast("array<string>")
    fields = ["dataset_order", "inventory", "institution", "title", "description", "source_urls", "departments", "classification_status", "review_reasons", "primary_academic_area", "areas"]
    kept = rows.groupBy("course_key").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("all")).withColumns({"first": F.get("all", F.lit(0)), "later": F.expr("slice(all, 2, greatest(size(all) - 1, 0))")})
    union = lambda c: F.array_distinct(F.flatten(F.transform("all", lambda x: F.coalesce(x[c], none))))
    same = lambda a, b: F.array_sort(F.array_distinct(F.coalesce(a, none))) == F.array_sort(F.array_distinct(F.coalesce(b, none)))
    told = F.filter("later", lambda x: (F.coalesce(x["description"], F.lit("")) != "") & ~x["description"].eqNullSafe(F.col("first.description")))
    other = F.filter("later", lambda x: ~(x["primary_academic_area"].eqNullSafe(F.col("first.primary_academic_area")) & same(x["areas"], F.col("first.areas"))))
    asked = F.filter("later", lambda x: x["classification_status"] == "needs-review")
    made = kept.withColumns({"told": told, "other": other, "asked": asked})
    reasons = F.concat(
        F.coalesce("first.review_reasons", none), F.flatten(F.transform("asked", lambda x: F.coalesce(x["review_reasons"], none))),
        F.when(F.size("asked") > 0, F.array(F.lit("source-classification-needs-review"))).otherwise(none), F.when(F.size("other") > 0, F.array(F.lit("conflicting-source-classifications"))).otherwise(none),
    )
    changed = (F.size("asked") > 0) | (F.size("other") > 0)
    return made.select(
        "course_key", "first.institution", "first.title", "first.description", union("source_urls").alias("source_urls"), union("departments").alias("departments"), "first.primary_academic_area",
        F.when(changed, "needs-review").otherwise(F.col("first.classification_status")).alias("classification_status"),
        F.when(changed, F.array_sort(F.array_distinct(reasons))).otherwise(F.coalesce("first.review_reasons", none)).alias("review_reasons"),
        F.transform("told", lambda x: F.struct(x["inventory"].alias("inventory"), x["description"].alias("description"))).alias("description_variants"),
        F.transform("other", lambda x: F.struct(x["inventory"].alias("inventory"), x["primary_academic_area"].alias("primary_academic_area"))).alias("classification_variants"),
        F.transform("all", lambda x: x["inventory"]).alias("inventories"),
    )


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """Write a small file to any store that Spark reaches."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(content))
    out.close()


def put_dataset(spark: SparkSession, folder: str, files: dict[str, tuple[str | None, bytes, int]], **manifest: str) -> None:
    """Files (name: collection, content, records) with a manifest that names them."""
    import hashlib

    for name, (_, content, _) in files.items():
        put(spark, f"{folder}/{name}", content)
    entries = [{"file": n, "collection": c, "sha256": hashlib.sha256(b).hexdigest(), "records": k} for n, (c, b, k) in files.items()]
    put(spark, f"{folder}/manifest.json", json.dumps(manifest | {"files": entries}).encode())
