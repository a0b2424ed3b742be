"""Chat formatting: every participant's view of a dialogue, with DataFrame functions only.

For each participant (each distinct role but ``system``) a dialogue is rendered once, over
all its turns, with that speaker as the assistant and all others as named users. The mask
lists the character ranges of the assistant's own words, which are what a model is trained on.

A rendering is stored in chunks of ``CHUNK_TURNS`` turns, so that no task gathers a dialogue
of unbounded length. Chunks of one view, end to end, are the rendering: ``start`` is where a
chunk begins in it, and mask ranges count from the beginning of the rendering.

1. Turns are put in order by range, so that a long dialogue spreads over partitions; the
   number of turns in front of a partition gives every turn its place in its dialogue.
2. Participants of the dialogue join each chunk; every chunk is rendered for each of them.
3. Running sums over the chunks' lengths give their starts.

Defined cases: a null text is empty; a null role is the participant ``unknown``; white space
in a role is one blank; a turn marker inside a text is broken by a blank (``<| im_``), so no
text forges a turn; null turns come first; equal turns are ordered by role, then by the MD5
of the text; repeated rows are repeated turns; a dialogue with system turns only has no
participant and no row; rows with a null conv_id form one dialogue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .textops import SharedTables

CHUNK_TURNS = 1024
OPEN, CLOSE, MARK = "<|im_start|>", "<|im_end|>\n", "<|im_"


def _in_order(turns: DataFrame, kept: SharedTables) -> DataFrame:
    """conv_id, role, text, and where each turn stands in the order of all: ``at``, whose upper bits are its ``range``."""
    # repeated rows are told apart, so that a range may end between them
    keys = ["conv_id", F.col("turn").asc_nulls_first(), "role", "tie", "copy"]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = turns.withColumns({"tie": F.md5("text"), "copy": F.monotonically_increasing_id()}).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    return kept.store(ranged.withColumn("at", at).withColumn("range", F.shiftright("at", 33)).drop("tie", "copy", "turn"), large=True)


def _chunked(placed: DataFrame, sizes: DataFrame, chunk_turns: int) -> DataFrame:
    """``placed`` with ``ord``, the place of a turn in its dialogue from 0, and its ``chunk``; ``sizes`` are turns a dialogue and range."""
    # of each range only the first dialogue can have begun before it, so there is one row a range
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begun = sizes.withColumn("before", F.sum("n").over(earlier)).where("before is not null").select(F.col("conv_id").alias("own"), F.col("range").alias("its"), "before")
    here = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy("at"))
    numbered = placed.withColumn("here", here).join(F.broadcast(begun), F.col("conv_id").eqNullSafe(F.col("own")) & (F.col("range") == F.col("its")), "left")
    ord_ = (F.col("here") - 1 + F.coalesce("before", F.lit(0))).cast("bigint")
    return numbered.withColumn("ord", ord_).withColumn("chunk", F.floor(F.col("ord") / chunk_turns)).drop("at", "range", "here", "own", "its", "before")


def perspectives(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """conv_id, chunk, participant, n_turns, n_masked_turns, start, rendered, mask (array of [start, end) in characters)."""
    kept = SharedTables(turns.sparkSession)
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.regexp_replace(F.coalesce(role, F.lit("unknown")), r"\s+", " ").alias("role"),
        F.replace(F.coalesce(text, F.lit("")), F.lit(MARK), F.lit("<| im_")).alias("text"),
    )
    placed = _in_order(rows, kept)
    sizes = kept.store(placed.groupBy("conv_id", "range").agg(F.count("*").alias("n")))
    last = F.floor((F.sum("n") - 1) / chunk_turns)
    chunks = sizes.groupBy("conv_id").agg(last.alias("last")).select("conv_id", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("chunk"))
    who = placed.where("role <> 'system'").select(F.col("conv_id").alias("own"), F.col("role").alias("participant")).distinct()
    wanted = chunks.join(who, F.col("conv_id").eqNullSafe(F.col("own"))).select(F.col("conv_id").alias("own"), F.col("chunk").alias("its"), "participant")
    mine = F.col("role") == F.col("participant")
    head = F.when(mine, F.lit(f"{OPEN}assistant\n")).when(F.col("role") == "system", F.lit(f"{OPEN}system\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), F.col("role"), F.lit("\n")))
    seen = lambda rows: rows.join(wanted, F.col("conv_id").eqNullSafe(F.col("own")) & (F.col("chunk") == F.col("its"))).select("conv_id", "chunk", "participant", "ord", mine.alias("mine"), head.alias("head"), *[c for c in ("text", "size") if c in rows.columns])
    view = ["conv_id", "chunk", "participant"]
    # lengths alone say where chunks start; texts need not move for it
    lean = _chunked(placed.select("conv_id", "at", "range", "role", F.length("text").alias("size")), sizes, chunk_turns)
    lengths = seen(lean).groupBy(*view).agg(F.sum(F.length("head") + F.col("size") + len(CLOSE)).alias("length"))
    before = Window.partitionBy("conv_id", "participant").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = lengths.select(F.col("conv_id").alias("own"), F.col("chunk").alias("its"), F.col("participant").alias("whose"), F.coalesce(F.sum("length").over(before), F.lit(0)).cast("bigint").alias("start"))
    within = Window.partitionBy(*view).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    pieces = seen(_chunked(placed, sizes, chunk_turns)).withColumn("piece", F.concat("head", "text", F.lit(CLOSE))).withColumn("stop", F.sum(F.length("piece")).over(within))
    first = F.col("stop") - F.length("piece") + F.length("head")
    span = F.when(F.col("mine"), F.struct("ord", first.alias("start"), (first + F.length("text")).alias("end")))
    made = pieces.groupBy(*view).agg(
        F.count("*").alias("n_turns"),
        F.count_if("mine").alias("n_masked_turns"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "piece"))), lambda x: x["piece"]), "").alias("rendered"),
        F.array_sort(F.collect_list(span)).alias("spans"),
    )
    joined = made.join(starts, F.col("conv_id").eqNullSafe(F.col("own")) & (F.col("chunk") == F.col("its")) & (F.col("participant") == F.col("whose")))
    move = lambda x: F.struct((x["start"] + F.col("start")).cast("bigint").alias("start"), (x["end"] + F.col("start")).cast("bigint").alias("end"))
    return joined.select(*view, "n_turns", "n_masked_turns", "start", "rendered", F.transform("spans", move).alias("mask"))


def perspective_report(turns: DataFrame, **columns) -> DataFrame:
    """``perspectives`` with the mask spelled start-end, comma-joined."""
    return perspectives(turns, **columns).withColumn("mask", F.array_join(F.transform("mask", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ","))


SQL = f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, regexp_replace(coalesce(role, 'unknown'), '\\s+', ' ', 'g'), md5(replace(coalesce(text, ''), '{MARK}', '<| im_'))) - 1 AS ord,
    regexp_replace(coalesce(role, 'unknown'), '\\s+', ' ', 'g') AS role, replace(coalesce(text, ''), '{MARK}', '<| im_') AS text FROM conversations
), p AS (
  SELECT DISTINCT conv_id, role AS participant FROM t WHERE role <> 'system'
), v AS (
  SELECT t.*, participant, role = participant AS mine,
    CASE WHEN role = participant THEN '{OPEN}assistant' || chr(10) WHEN role = 'system' THEN '{OPEN}system' || chr(10) ELSE '{OPEN}user name=' || role || chr(10) END AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), o AS (
  SELECT *, sum(length(head) + length(text) + 11) OVER (PARTITION BY conv_id, participant ORDER BY ord ROWS UNBOUNDED PRECEDING) AS stop FROM v
)
SELECT conv_id, ord // {CHUNK_TURNS} AS chunk, participant, count(*) AS n_turns, count(*) FILTER (WHERE mine) AS n_masked_turns,
  min(stop - length(head) - length(text) - 11)::BIGINT AS start,
  string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY ord) AS rendered,
  coalesce(string_agg((stop - 11 - length(text))::BIGINT::VARCHAR || '-' || (stop - 11)::BIGINT::VARCHAR, ',' ORDER BY ord) FILTER (WHERE mine), '') AS mask
FROM o GROUP BY conv_id, chunk, participant
"""

__all__ = ["SQL", "perspective_report", "perspectives"]
