"""An inverted index of texts that is stored once, kept current batch by batch, and searched without reading all of it.

Under its folder, every batch adds a partition to three tables:

* ``postings``: one row per term and block of documents (``BLOCK`` ids), in files by a hash of the term and sorted by term and
  block: the block's greatest term frequency and least length beside the postings themselves.
* ``texts``: (doc_id, fingerprint, dl) of what the batch indexed.
* ``dead``: (doc_id, of, block, dl) of earlier batches' documents that it replaced or removed.

A batch compares its texts' fingerprints with the index and only indexes new and changed ones. It reads earlier batches only and
replaces its own folders, ``texts`` last, so running a batch again gives the same index.

Search is BM25 by block-max pruning: the heads of the query's terms bound what a document of each block can score; the best few
blocks are scored first, and then only those whose bound reaches the k-th score found. Statistics come from heads, too; only
blocks with dead documents are opened for them. What goes through the driver are the terms' frequencies, one score, and the
numbers of at most ``LISTED`` blocks, which become a filter that reaches the scan; more are joined.

Rows without an id are not indexed; a null text is empty; of rows with one id in a batch, the greatest text counts.
"""

from __future__ import annotations

import logging
import math
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import stored

K1, B = 1.2, 0.75
#: Documents with neighbouring ids in a block, at most.
BLOCK = 256
BUCKETS = 64
#: Blocks scored before any is ruled out, and how many numbers of blocks may become a filter.
FIRST_BLOCKS = 4
LISTED = 1000

_SCHEMA = {
    "postings": "term string, block bigint, n bigint, max_tf bigint, min_dl int, postings array<struct<doc_id: bigint, tf: bigint, dl: int>>, batch bigint, bucket bigint",
    "texts": "doc_id bigint, fingerprint string, dl int, batch bigint",
    "dead": "doc_id bigint, of bigint, block bigint, dl int, batch bigint",
}
log = logging.getLogger(__name__)


class TextIndex:
    """The index in a folder, which is made if there is none. ``unicode`` and ``buckets`` belong to the index: give the same each time."""

    def __init__(self, spark: SparkSession, path: str, *, buckets: int = BUCKETS, unicode: bool = True):
        self.spark, self.path, self.buckets, self.unicode = spark, path, buckets, unicode
        #: Of the last search: blocks opened, and blocks that hold a term of the query.
        self.opened = (0, 0)
        for name in _SCHEMA:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(_SCHEMA[name]).parquet(f"{self.path}/{name}")

    def _bucket(self, term: Column) -> Column:
        return F.crc32(term) % self.buckets

    # --- upkeep

    def documents(self, before: int | None = None) -> DataFrame:
        """(doc_id, fingerprint, dl, batch) of what is indexed now, or was before a batch."""
        texts, dead = self.table("texts"), self.table("dead")
        if before is not None:
            texts, dead = texts.where(F.col("batch") < before), dead.where(F.col("batch") < before)
        return texts.join(dead.select("doc_id", F.col("of").alias("batch")), ["doc_id", "batch"], "left_anti").select("doc_id", "fingerprint", "dl", "batch")

    def add(self, docs: DataFrame, batch: int, *, doc_id: str = "doc_id", text: str = "text") -> None:
        """Index the texts that are new or have changed.

        Texts are dealt by block, and so is what comes of them: occurrences are counted in the row of their document and a
        block's postings gathered where its documents are, so that only finished blocks move on to the files of their terms.
        """
        block = F.floor(F.col("doc_id") / BLOCK)
        rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("doc_id is not null")
        rows = rows.withColumn("block", block).repartition("block").groupBy("block", "doc_id").agg(F.max("text").alias("text")).withColumn("fingerprint", F.sha2("text", 256))
        old = self.documents(batch).select(block.alias("block"), "doc_id", F.col("fingerprint").alias("was"), F.col("dl").alias("was_dl"), F.col("batch").alias("of"))
        fresh = rows.join(old, ["block", "doc_id"], "left").where("was is null or was <> fingerprint").withColumn("words", F.sort_array(tokens(F.col("text"), self.unicode))).drop("text")
        # as one string: no word has a space in it
        fresh = stored(fresh.withColumn("dl", F.size("words")).withColumn("words", F.array_join("words", " ")))
        # equal words stand together: where each begins tells how many there are
        begins = F.filter(F.transform("words", lambda w, i: F.when((i == 0) | (F.get("words", i - 1) != w), i)), lambda i: i.isNotNull())
        runs = F.transform("begins", lambda p, j: F.struct(F.get("words", p).alias("term"), (F.coalesce(F.get("begins", j + 1), F.col("dl")) - p).alias("tf")))
        each = fresh.where("dl > 0").select("block", "doc_id", "dl", "words").repartition("block").withColumn("words", F.split("words", " ")).withColumn("begins", begins).select("block", "doc_id", "dl", F.inline(runs))
        own = F.sort_array(F.collect_list(F.struct((F.col("doc_id") - F.col("block") * BLOCK).cast("int").alias("at"), "tf", "dl")))
        # on the way a block is one array of whole numbers, three a document
        flat = F.flatten(F.transform(own, lambda x: F.array(x["at"], x["tf"], x["dl"])))
        moved = each.groupBy("term", "block").agg(flat.alias("own")).repartition(self._bucket(F.col("term")))
        nth = lambda k: F.transform(F.sequence(F.lit(0), (F.size("own") / 3).cast("int") - 1), lambda i: F.get("own", 3 * i + k))
        parted = moved.select("term", "block", nth(0).alias("at"), nth(1).alias("tf"), nth(2).alias("dl"), self._bucket(F.col("term")).alias("bucket"))
        entry = F.transform("at", lambda x, i: F.struct((F.col("block") * BLOCK + x).alias("doc_id"), F.get("tf", i).cast("bigint").alias("tf"), F.get("dl", i).alias("dl")))
        dealt = parted.sortWithinPartitions("bucket", "term", "block").select("term", "block", F.size("at").cast("bigint").alias("n"), F.array_max("tf").cast("bigint").alias("max_tf"), F.array_min("dl").alias("min_dl"), entry.alias("postings"), "bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/batch={batch}")
        self._bury(fresh.where("of is not null").select("doc_id", "of", F.col("was_dl").alias("dl")), batch)
        fresh.select("doc_id", "fingerprint", "dl").write.mode("overwrite").parquet(f"{self.path}/texts/batch={batch}")

    def remove(self, ids: DataFrame, batch: int) -> None:
        """Documents with these ids leave the index in a batch of their own."""
        gone = ids.select(F.col(ids.columns[0]).cast("bigint").alias("doc_id")).distinct()
        self._bury(self.documents(batch).join(gone, "doc_id", "left_semi").select("doc_id", F.col("batch").alias("of"), "dl"), batch)

    def _bury(self, rows: DataFrame, batch: int) -> None:
        rows.withColumn("block", F.floor(F.col("doc_id") / BLOCK)).write.mode("overwrite").parquet(f"{self.path}/dead/batch={batch}")

    # --- reading

    def _alive(self, postings: DataFrame) -> DataFrame:
        """(batch, term, doc_id, tf, dl) of the blocks, without dead documents."""
        each = postings.select("batch", "term", F.inline("postings"))
        return each.join(self.table("dead").select("doc_id", F.col("of").alias("batch")), ["doc_id", "batch"], "left_anti")

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """(term, doc_id, tf, dl) of all documents or for some terms, which only opens their files."""
        rows = self.table("postings") if terms is None else self._of(terms)
        return self._alive(rows).select("term", "doc_id", "tf", "dl")

    def _of(self, terms: list[str]) -> DataFrame:
        return self.table("postings").where(F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % self.buckets for t in terms})) & F.col("term").isin(terms))

    def frequencies(self, terms: list[str]) -> DataFrame:
        """(term, df) of those terms that a document has; postings are only opened in blocks with dead documents."""
        rows, dead = self._of(terms), self.table("dead").select("doc_id", "block", F.col("of").alias("batch"))
        held = rows.groupBy("term").agg(F.sum("n").alias("n"))
        dirty = rows.select("batch", "block", "term", "postings").join(dead.select("batch", "block").distinct(), ["batch", "block"], "left_semi")
        lost = dirty.select("batch", "term", F.inline("postings")).join(dead, ["doc_id", "batch"], "left_semi").groupBy("term").agg(F.count("*").alias("lost"))
        return held.join(lost, "term", "left").select("term", (F.col("n") - F.coalesce("lost", F.lit(0))).alias("df")).where("df > 0")

    def totals(self) -> tuple[int, float]:
        """Documents in the index and their mean length."""
        count = lambda name: self.table(name).agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        (n, size), (dead_n, dead_size) = count("texts"), count("dead")
        return n - dead_n, (size - dead_size) / (n - dead_n) if n > dead_n else 0.0

    def search(self, terms: list[str], k: int) -> DataFrame:
        """(doc_id, rank): the k best by BM25 (k1 = 1.2, b = 0.75, idf at least 1e-6), negated so that less is better, ties by id."""
        wanted = sorted(set(terms))
        n, mean = self.totals()
        df = {r.term: r.df for r in self.frequencies(wanted).limit(len(wanted)).collect()} if wanted and n else {}
        self.opened = (0, 0)
        if not df:
            return self.spark.createDataFrame([], "doc_id bigint, rank double")
        idf = F.create_map(*[x for t, d in sorted(df.items()) for x in (F.lit(t), F.lit(max(math.log((n - d + 0.5) / (d + 0.5)), 1e-6)))])
        weight = lambda tf, dl: idf[F.col("term")] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / (mean or 1.0)))
        rows = self._of(list(df))
        bounds = stored(rows.groupBy("batch", "block").agg(F.sum(weight(F.col("max_tf"), F.col("min_dl"))).alias("bound")))

        def scored(blocks: DataFrame) -> DataFrame:
            few = blocks.select("batch", "block").limit(LISTED + 1).collect()
            if len(few) <= LISTED:
                own = rows.where(F.col("batch").isin(sorted({b.batch for b in few})) & F.col("block").isin(sorted({b.block for b in few})))
                own = own.where(F.struct("batch", "block").isin([F.struct(F.lit(b.batch).cast("bigint"), F.lit(b.block).cast("bigint")) for b in few])) if few else own.where("false")
            else:
                own = rows.join(blocks.select("batch", "block"), ["batch", "block"], "left_semi")
            found = self._alive(own).groupBy("doc_id").agg((-F.sum(weight(F.col("tf"), F.col("dl")))).alias("rank"))
            return found.orderBy(F.round("rank", 9), "doc_id").limit(k)

        first = scored(bounds.orderBy(F.desc("bound"), "batch", "block").limit(max(FIRST_BLOCKS, math.ceil(k / BLOCK)))).agg(F.count("*").alias("n"), F.max("rank").alias("worst")).first()
        # what rounds to the k-th score is still in the run
        needed = bounds.where(F.col("bound") >= -first.worst - 1e-8) if first.n == k else bounds
        seen = needed.count(), bounds.count()
        self.opened = (seen[0], seen[1])
        log.info("search of %d terms opens %d of %d blocks", len(df), *self.opened)
        return scored(needed)


__all__ = ["TextIndex"]
