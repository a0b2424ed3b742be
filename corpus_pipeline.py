"""A training-data pipeline: language, lines, near-duplicates, benchmark leaks, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. It is written as
Parquet in the cluster's shared folder and read again as the next stage's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessergrid.llm import decontaminate, language_mix, line_dedup, near_duplicates, tokenize_bpe
from tessergrid.llm.queries import PATTERN, RANK_FILE
from tessergrid.llm.textops import delete, ensure_checkpoint_dir, table, unused


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language or in several; texts without any go."""
    return language_mix.keep_identified(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that earlier lines repeat; n_chars follows. A text left without any line goes."""
    (had,) = unused(docs, "had")
    lean = line_dedup.drop_repeated_lines(docs.withColumn(had, F.length("text")))
    lean = lean.where(F.col(had).isNull() | (F.col(had) == 0) | (F.trim("text") != ""))
    return lean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint"))).drop(had)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates."""
    return near_duplicates.keep_one(docs)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.remove_leaked(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document in place of its text, with digests of the ids and of what they decode to."""
    return tokenize_bpe.token_digests(docs, RANK_FILE, PATTERN, with_ids=True)


STAGES = [
    ("language", language_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", duplicate_stage),
    ("decontamination", leak_stage),
    ("tokens", token_stage),
]

#: Similarity joins, mixture inference and BPE have no SQL form; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        if k:
            delete(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    delete(spark, folder, at_exit=True)
    return docs
