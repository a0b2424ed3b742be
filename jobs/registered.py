"""The jobs as queries: run twice over whole tables into a new folder, which stays, and read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessergrid.session import shared_folder

from . import index_texts, publish_ledger


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_index_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, doc_id, tf, dl): the index of ``documents``; the second run finds nothing new."""
    folder = _folder(spark, "job1_index_texts")
    for _ in range(2):
        made = index_texts.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/index", f"{folder}/checkpoint", unicode=False)
    return made.postings()


def job2_publish_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published ledger; the second run finds it unchanged."""
    folder = _folder(spark, "job2_publish_ledger")
    for _ in range(2):
        publish_ledger.run(spark, sf_dir, folder)
    return publish_ledger.read_ledger(spark, folder)


JOB1_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(max(text), '')), '[a-z]+') AS w FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id)
SELECT term, doc_id, count(*) AS tf, any_value(dl)::INTEGER AS dl FROM (SELECT doc_id, unnest(w) AS term, len(w) AS dl FROM d) GROUP BY term, doc_id"""

JOB2_SQL = """
WITH p AS (
  SELECT l_suppkey AS course_id, l_partkey AS material_id, count(*) AS n_evidence, count(DISTINCT l_orderkey) AS n_orders, min(l_shipdate::DATE) AS first_seen, max(l_shipdate::DATE) AS last_seen,
    list_sort(list(DISTINCT l_linestatus)) AS statuses, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL
), r AS (SELECT p.*, s_name AS course, n_name AS institution, p_name AS material, p_type AS kind FROM p JOIN supplier ON s_suppkey = course_id JOIN nation ON n_nationkey = s_nationkey JOIN part ON p_partkey = material_id
), m AS (SELECT material_id, count(DISTINCT course_id) AS n_courses, count(DISTINCT institution) AS places FROM r GROUP BY material_id)
SELECT r.*, n_courses, CASE WHEN n_courses < 2 THEN 'single' WHEN places > 1 THEN 'cross-identity' ELSE 'same-identity' END AS recurrence FROM r JOIN m USING (material_id)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_index_texts, job2_publish_ledger)}


def oracle_sql() -> dict[str, str]:
    return {"job1_index_texts": JOB1_SQL, "job2_publish_ledger": JOB2_SQL}
