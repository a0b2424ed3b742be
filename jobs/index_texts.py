"""Keep a search index of a growing folder of texts current: a file stream that takes only new files.

    spark-submit jobs/index_texts.py --config jobs/index_texts.json [--documents PATH] [--index PATH] [--checkpoint PATH]

Every run takes the files that have come since the last one (in batches of ``files_per_batch``) and ends. Texts that are indexed
already and have not changed are left alone; a changed text replaces the former. The stream's checkpoint remembers what was
taken; a batch that was cut short runs again under its number and replaces what it had left. Index and checkpoint belong
together: to start over, give a new folder for both.
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tessergrid import get_session  # noqa: E402
from tessergrid.operators.text_index import TextIndex  # noqa: E402

CONFIG = Path(__file__).with_suffix(".json")
log = logging.getLogger("index_texts")


def run(spark: SparkSession, documents: str, index: str, checkpoint: str, *, doc_id: str = "doc_id", text: str = "text", buckets: int = 64, unicode: bool = True, files_per_batch: int = 1000) -> TextIndex:
    """Index what is new under ``documents`` (Parquet) and return the index."""
    schema = spark.read.parquet(documents).select(doc_id, text).schema
    made = TextIndex(spark, index, buckets=buckets, unicode=unicode)

    def take(rows: DataFrame, batch: int) -> None:
        TextIndex(rows.sparkSession, index, buckets=buckets, unicode=unicode).add(rows, batch, doc_id=doc_id, text=text)

    new = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    place = spark._jvm.org.apache.hadoop.fs.Path(documents)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():  # a stream reads folders: this file of its folder
        new = new.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())
    else:
        new = new.parquet(documents)
    stream = new.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    # one record a batch
    log.info("read %d rows of %s in %d batches", sum(p.numInputRows for p in stream.recentProgress), documents, sum(p.numInputRows > 0 for p in stream.recentProgress))
    log.info("index %s holds %d documents of %.1f words on average", index, *made.totals())
    return made


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__.split("\n\n")[0])
    parser.add_argument("--config", default=str(CONFIG))
    for name in ("documents", "index", "checkpoint"):
        parser.add_argument(f"--{name}")
    args = vars(parser.parse_args(argv))
    options = json.loads(Path(args.pop("config")).read_text()) | {k: v for k, v in args.items() if v}
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = get_session("index_texts")
    try:
        run(spark, **options)
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
