"""Reading checked inventories: XZ archives, JSON and JSONL files, dataset folders, evidence, reports.

Files are read by Spark (``binaryFile`` or ``json``), so any store it reaches will do. A file whose hash, count
or keys are not what its manifest says raises before any row is used.
"""

from __future__ import annotations

import hashlib
import json
import lzma
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import assert_empty
from ..operators.joins import mismatches

#: An archive may unpack to so many bytes.
MOST_BYTES = 20_000_000
# The collections that a file may hold, in the order in which they are looked for.
COLLECTIONS = ("classifications", "courses", "records", "reviews", "sample")


def _binary(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def read_multipart_xz(spark: SparkSession, folder: str, manifest: dict, collection: str, schema: str) -> DataFrame:
    """Rows of a collection of an archive in parts <name>.000, .001 ..: every part's size and hash, their order,
    the whole's hash and unpacked size are checked against the manifest (parts: name, bytes, sha256; sha256; json_sha256)."""
    parts = manifest["parts"]
    stem = parts[0]["name"].rsplit(".", 1)[0]
    if [p["name"] for p in parts] != [f"{stem}.{i:03d}" for i in range(len(parts))]:
        raise ValueError("the parts of an archive are numbered from 000 without a gap")
    if sum(p["bytes"] for p in parts) > MOST_BYTES:
        raise ValueError("the archive is larger than an archive may be")
    files = _binary(spark, folder, f"{stem}.*").select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    expected = spark.createDataFrame([(p["name"], p["bytes"], p["sha256"]) for p in parts], "name string, bytes bigint, sha256 string")
    assert_empty(expected.join(files, ["name", "bytes", "sha256"], "left_anti"), "parts that are missing or changed")
    # bounded by MOST_BYTES, which the sizes above have been held to
    got = {r["path"].rsplit("/", 1)[1]: bytes(r["content"]) for r in _binary(spark, folder, f"{stem}.*").select("path", "content").collect()}
    packed = b"".join(got[p["name"]] for p in parts)
    if hashlib.sha256(packed).hexdigest() != manifest["sha256"]:
        raise ValueError("the archive is not the one the manifest names")
    text = lzma.LZMADecompressor().decompress(packed, MOST_BYTES + 1)
    if len(text) > MOST_BYTES:
        raise ValueError("the archive unpacks to more than an archive may hold")
    if hashlib.sha256(text).hexdigest() != manifest["json_sha256"]:
        raise ValueError("the archive's content is not what the manifest names")
    rows = [json.dumps(r, ensure_ascii=False) for r in json.loads(text)[collection]]
    return spark.createDataFrame([(r,) for r in rows], "value string").select(F.from_json("value", schema).alias("r")).select("r.*")


def read_payloads(spark: SparkSession, path: str, schema: str, expected: DataFrame | None = None) -> DataFrame:
    """(file, then the row's columns) of JSON or XZ files that hold a list, or an object with one of COLLECTIONS.

    ``expected`` (file, sha256, records) is checked before rows are used. Files are unpacked where they are read.
    """
    rows = unpacked(spark, path)
    if expected is not None:
        found = rows.select("file", "sha256", "records").distinct()
        assert_empty(expected.join(found, ["file", "sha256", "records"], "left_anti"), "files that are missing or changed")
    return rows.select("file", F.from_json("value", schema).alias("r")).select("file", "r.*")


def unpacked(spark: SparkSession, paths: list[str] | str, collections: tuple[str, ...] = COLLECTIONS) -> DataFrame:
    """(dataset, file, sha256, records, value): the rows of files as JSON, with the folder they are in."""
    part = lambda k: F.element_at(F.split("path", "/"), k)
    files = spark.read.format("binaryFile").load(paths).select(part(-2).alias("dataset"), part(-1).alias("file"), "content")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for dataset, name, content in zip(pdf["dataset"], pdf["file"], pdf["content"], strict=True):
                text = lzma.decompress(content) if name.endswith(".xz") else content
                data = json.loads(text)
                if isinstance(data, dict):
                    data = next((data[c] for c in collections if isinstance(data.get(c), list)), None)
                if not isinstance(data, list):
                    raise ValueError(f"{name} holds no known collection")
                out += [(dataset, name, hashlib.sha256(content).hexdigest(), len(data), json.dumps(r, ensure_ascii=False)) for r in data]
            yield pd.DataFrame(out, columns=["dataset", "file", "sha256", "records", "value"])

    return files.mapInPandas(unpack, "dataset string, file string, sha256 string, records bigint, value string")


def load_pairs(spark: SparkSession, pairs: list[tuple[str, str]], schema: str, label_schema: str, key: str = "course_key") -> DataFrame:
    """Inventories joined one to one with their classifications, pair by pair, under the union of their columns."""
    out = None
    for i, (inventory, labels) in enumerate(pairs):
        a, b = read_payloads(spark, inventory, schema).drop("file"), read_payloads(spark, labels, label_schema).drop("file")
        assert_empty(mismatches(a, b, key), f"keys of {inventory} and {labels}")
        pair = a.join(b, key).withColumn("dataset_order", F.lit(i))
        out = pair if out is None else out.unionByName(pair, allowMissingColumns=True)
    return out


def read_jsonl(spark: SparkSession, path: str, schema: str, key: str, records: int, sha256: str | None = None) -> DataFrame:
    """A JSONL catalogue whose row count and unique ids (and hash, for one file) are as promised."""
    if sha256 is not None:
        got = [r[0] for r in _binary(spark, path).select(F.sha2("content", 256)).limit(2).collect()]
        if got != [sha256]:
            raise ValueError("the catalogue is not the one the manifest names")
    rows = spark.read.schema(schema).json(path)
    n, ids = rows.agg(F.count("*"), F.count_distinct(key)).first()
    if n != records or ids != n:
        raise ValueError(f"{n} rows with {ids} ids where {records} are promised")
    return rows


def evidence(rows: DataFrame, key: str, wanted: str, payload: str, fingerprint: str) -> DataFrame:
    """The record with an id, if its payload still has its recorded hash; raises if not."""
    found = rows.where(F.col(key) == wanted)
    assert_empty(found.where(F.sha2(F.col(payload), 256) != F.col(fingerprint)).select(key), "evidence that has changed")
    return found


def read_evidence(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows of evidence-*.json files: ids unique over all files, one day of checking."""
    rows = read_payloads(spark, f"{folder}/evidence-*.json", schema)
    assert_empty(rows.groupBy("evidence_id").count().where("count > 1"), "repeated evidence ids")
    if rows.agg(F.count_distinct("checked_on")).first()[0] > 1:
        raise ValueError("evidence was checked on several days")
    return rows


def read_tagged(spark: SparkSession, path: str, schema: str, tag: str) -> DataFrame:
    """One JSON object whose ``format`` is ``tag``."""
    rows = spark.read.schema(f"format string, {schema}").option("multiLine", True).json(path)
    assert_empty(rows.where(~F.col("format").eqNullSafe(tag)).select("format"), f"not a {tag} file")
    return rows.drop("format")


def import_report(requested: DataFrame, report: DataFrame, key: str) -> DataFrame:
    """Every requested row with its reported status; ``not-completed`` where there is none; strangers and repeats raise."""
    assert_empty(report.join(requested, key, "left_anti").select(key), "results nobody asked for")
    assert_empty(report.groupBy(key).count().where("count > 1"), "repeated results")
    return requested.join(report, key, "left").withColumn("status", F.coalesce("status", F.lit("not-completed")))
